"""Training-data operators: packing, quality, tokens, fingerprints, archives,
sharding, privacy, secrets and near duplicates.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
