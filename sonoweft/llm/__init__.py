"""Operations of a training-data pipeline over documents, pages and conversations.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it is present.
"""
