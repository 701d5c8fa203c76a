"""marginalia.functions"""
