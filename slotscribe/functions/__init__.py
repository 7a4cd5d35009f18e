"""Column functions: names, discriminators, little-endian readers, base58, layout decoding."""
