"""marginalia.plans"""
