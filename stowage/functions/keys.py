"""Stable keys: name-based UUIDs, item keys, content identity."""

from pyspark.sql import Column
from pyspark.sql import functions as F

URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"  # RFC 4122's namespace for URLs


def uuid5(name: Column) -> Column:
    """The version 5 UUID of a name in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), name.cast("binary")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab89ab89ab89ab"]), F.instr(F.lit("0123456789abcdef"), F.substring(h, 17, 1)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def album_key(albumartist: Column, album: Column, ext_id: Column, prefix: str = "stowage:album:") -> Column:
    """Of the external id where there is one, else of the pair of artist and album; ``prefix`` tells key families apart."""
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    basis = F.when(clean(ext_id) != "", F.concat(F.lit("mb:"), clean(ext_id))).otherwise(F.concat(F.lit("aa:"), clean(albumartist), F.lit("\x00"), clean(album)))
    return uuid5(F.concat(F.lit(prefix), basis))


def location_key(name: Column, prefix: str = "stowage:location:") -> Column:
    return uuid5(F.concat(F.lit(prefix), F.lower(F.trim(name))))


def item_key(source: Column, source_id: Column) -> Column:
    return F.concat_ws(":", source, source_id)


def resolve_key(token: Column, source: str) -> Column:
    """``source:id`` of a full key or a bare id; null if either half is empty. Only the first colon splits."""
    t = F.trim(token)
    at = F.instr(t, ":")
    return F.when(t == "", F.lit(None)).when(at == 0, F.concat(F.lit(f"{source}:"), t)).when((at > 1) & (at < F.char_length(t)), t)


def stream_digest(content: Column) -> Column:
    """The decoded-audio MD5 in a FLAC file's first metadata block; null if there is none or it is zero."""
    flac = (F.substring(content, 1, 4) == F.lit(b"fLaC")) & (F.octet_length(content) >= 42)
    digest = F.lower(F.hex(F.substring(content, 27, 16)))
    return F.when(flac & (digest != "0" * 32), digest)


def content_identity(content: Column) -> Column:
    """struct(identity, identity_kind): the audio digest, or else the file's SHA-256."""
    audio = stream_digest(content)
    return F.struct(F.coalesce(audio, F.sha2(content, 256)).alias("identity"), F.when(audio.isNotNull(), "audio_md5").otherwise("file_sha256").alias("identity_kind"))
