"""Operations on training text: scoring, packing, fingerprints, duplicates, search, tokens and page text."""
