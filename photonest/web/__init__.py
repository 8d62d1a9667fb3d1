"""photonest.web"""
