"""Operations of a training-data pipeline over documents, pages and embeddings.

One module per operator; `queries` registers one query for each over its whole table.
"""
