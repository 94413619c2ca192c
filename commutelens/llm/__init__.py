"""Operations of a training-data pipeline: filters, deduplication, scoring and mixing."""
