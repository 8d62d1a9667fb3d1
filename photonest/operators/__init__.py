"""photonest.operators"""
