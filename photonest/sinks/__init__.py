"""photonest.sinks"""
