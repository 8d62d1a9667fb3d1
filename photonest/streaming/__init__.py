"""photonest.streaming"""
