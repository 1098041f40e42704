"""Operations of a training-data pipeline: cleaning, deduplication, classification, mixing, formatting."""
