"""photonest.sources"""
