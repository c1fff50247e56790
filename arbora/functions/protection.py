"""Digests, stable ids and content encryption (built-in AES-GCM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IV_BYTES = 12
CRYPTO_VERSION = "aes-gcm-v1"


def content_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def content_key(text: Column, model: str, task: str, dims: int) -> Column:
    """Digest of the canonical JSON request; equal requests share one provider call."""
    request = F.struct(
        F.lit(dims).alias("dims"), F.lit(model).alias("model"), F.lit(task).alias("task"), text.alias("text")
    )
    return F.sha2(F.to_json(request), 256)


def stable_id(*parts: Column) -> Column:
    """Deterministic id, so a retried task or a re-run writes the same rows."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def synthetic_iv(node_id: Column, run_id: Column, content: Column) -> Column:
    """12-byte IV derived from node, run and content.

    Deterministic, so a retried task writes identical rows, and never repeated
    for two different contents under one key.
    """
    digest = F.sha2(F.concat_ws("|", node_id, run_id, F.sha2(content, 256)), 256)
    return F.unhex(F.substring(digest, 1, 2 * IV_BYTES))


def _base64(value: Column) -> Column:
    """Base64 on one line (the built-in breaks lines every 76 characters)."""
    return F.replace(F.base64(value), F.lit("\r\n"), F.lit(""))


def encrypt_content(content: Column, key: Column, iv: Column) -> dict[str, Column]:
    """Ciphertext with tag, IV and version as separate columns; the plain text is dropped by callers."""
    sealed = F.aes_encrypt(content, key, F.lit("GCM"), F.lit("DEFAULT"), iv)
    return {
        "encrypted_content": _base64(F.substring(sealed, IV_BYTES + 1, 2_147_483_647)),
        "content_iv": _base64(iv),
        "crypto_version": F.lit(CRYPTO_VERSION),
    }


def decrypt_content(encrypted: Column, iv: Column, key: Column) -> Column:
    """Plain text, or null when the key or the data does not match."""
    sealed = F.concat(F.unbase64(iv), F.unbase64(encrypted))
    return F.try_aes_decrypt(sealed, key, F.lit("GCM")).cast("string")
