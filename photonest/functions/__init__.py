"""photonest.functions"""
