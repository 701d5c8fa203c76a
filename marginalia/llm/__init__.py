"""Training-data operators: media, tokens, quality, licences, secrets, duplicates.

Nothing outside this subpackage imports it; ``queries.py`` holds its registered queries.
"""
