"""Operations of a training-data pipeline; nothing else in millrace imports this subpackage."""
