"""photonest.plans"""
