"""Operators for training data: near copies, language models, classifiers, personal data, tokens, shards, licences."""
