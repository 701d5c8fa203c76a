"""marginalia.operators"""
