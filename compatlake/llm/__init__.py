"""Operations of a training-data pipeline: dedup, tokens, chats, secrets, URLs, digests, languages, packing."""
