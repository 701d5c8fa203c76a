"""marginalia.sources"""
