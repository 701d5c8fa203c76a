"""marginalia.streaming"""
