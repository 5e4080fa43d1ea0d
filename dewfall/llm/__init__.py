"""Operations of a training-data pipeline: dedup, filters, mixing, packing, archives, search."""
