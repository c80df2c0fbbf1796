"""Queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from . import chat, embeddings, jaccard, languages, merkle, mixing, packing, private, secrets, sharding, substrings, trie, whitening


def queries():
    return {
        "op1_packing": packing.query,
        "op2_jaccard": jaccard.query,
        "op3_chat": chat.query,
        "op4_substrings": substrings.query,
        "op5_mixing": mixing.query,
        "op6_private": private.query,
        "op7_embeddings": embeddings.query,
        "op8_merkle": merkle.query,
        "op9_languages": languages.query,
        "op10_secrets": secrets.query,
        "op11_trie": trie.query,
        "op12_whitening": whitening.query,
        "op13_sharding": sharding.query,
    }


def oracle_sql():
    return {
        "op3_chat": chat.ORACLE,
        "op5_mixing": mixing.ORACLE,
        "op10_secrets": secrets.ORACLE,
        "op11_trie": trie.ORACLE,
        "op13_sharding": sharding.ORACLE,
    }
