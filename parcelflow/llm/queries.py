"""Queries of the training-data operators, by name, and SQL for those that SQL expresses."""

from . import bpe, chats, decontaminate, embeddings, licenses, near, quality, secrets, substrings, urls

QUERIES = {
    f.__name__: f
    for f in (
        decontaminate.op1_decontaminate, embeddings.op2_embeddings, secrets.op3_secrets, licenses.op4_licenses, chats.op5_chats,
        substrings.op6_substrings, quality.op7_quality, bpe.op8_bpe, urls.op9_urls, near.op10_near,
    )
}
ORACLE = {"op5_chats": chats.OP5_SQL}
