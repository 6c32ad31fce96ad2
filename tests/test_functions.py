import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings as hypothesis_settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import codecs, digests, filters, fixed, scalars, settings
from lodestrata.functions.settings import Options


@pytest.mark.parametrize("text, size", [("10", 10), ("1.5k", 1536), ("2KiB", 2048), ("3MB", 3 << 20), ("1T", 1 << 40), ("7b", 7), ("99999999999999999999", 2**64 - 1)])
def test_parse_size(text, size):
    assert scalars.parse_size(text) == size


@pytest.mark.parametrize("text", ["", "-1", "k", "1X", "1.2.3"])
def test_parse_size_refuses(text):
    with pytest.raises(ValueError):
        scalars.parse_size(text)


@pytest.mark.parametrize("text, seconds", [("1584286200", 1584286200), ("2020-03-15", 1584230400), ("1970-01-01", 0), ("1969-12-31", -86400), ("2021-02-31", 1614729600)])
def test_parse_date(text, seconds):
    assert scalars.parse_date(text) == seconds


@pytest.mark.parametrize("text", ["2020-13-01", "2020-00-10", "2020-01-32", "soon"])
def test_parse_date_refuses(text):
    with pytest.raises(ValueError):
        scalars.parse_date(text)


def test_extensions_and_kinds(spark):
    rows = [("a.jpg", "Jpeg"), ("A.JPEG", "Jpeg"), ("p.png", "Png"), ("p.APNG", "Png"), ("v.mp4", "Media"), ("README.md", "Other"), ("noext", "Other"), (".bashrc", "Other"), ("x.", "Other"), ("d.png/file", "Other")]
    found = spark.createDataFrame(rows, "rel string, kind string").select("rel", "kind", scalars.content_kind(scalars.extension(F.col("rel"))).alias("got")).collect()
    assert all(r.kind == r.got for r in found)


def test_sniff_goes_by_first_bytes(spark):
    rows = [(b"\xff\xd8rest", "Jpeg"), (b"\x89PNG\r\n", "Png"), (b"\xff", "Other"), (b"", "Other"), (None, "Other")]
    assert all(r.kind == r.got for r in spark.createDataFrame(rows, "body binary, kind string").select("kind", scalars.sniffed(F.col("body")).alias("got")).collect())


def test_text_heuristic(spark):
    rows = [(b"plain text\twith\nlines", True), (bytes(i % 256 for i in range(1024)), False), (b"", False), (b"123456789\x00", True), (b"12345678\x00\x01", False)]
    assert all(r.yes == r.got for r in spark.createDataFrame(rows, "body binary, yes boolean").select("yes", scalars.looks_like_text(F.col("body")).alias("got")).collect())


def test_digests(spark):
    bodies = [b"", None, b"abc", b"hello " * 500]
    rows = spark.createDataFrame([(b,) for b in bodies], "b binary").coalesce(1)  # nulls beside numbers
    assert rows.where("b IS NULL").select(digests.xxh3("b").alias("x")).first().x is None
    for r in rows.select("b", digests.xxh3("b").alias("x"), digests.crc32(F.col("b")).alias("c"), digests.blake3_digest("b").alias("k"), digests.trailer(F.col("b"), "crc32").alias("t"), digests.trailer(F.col("b"), "xxh3").alias("u")).collect():
        if r.b is None:
            assert r.x is None and r.k is None
            continue
        b = bytes(r.b)
        assert r.x % 2**64 == xxhash.xxh3_64_intdigest(b) and r.c == zlib.crc32(b)
        assert bytes(r.t) == struct.pack("<I", zlib.crc32(b)) and bytes(r.u) == struct.pack("<Q", xxhash.xxh3_64_intdigest(b))
        assert bytes(r.k) == digests.blake3(b)


def test_blake3_published_values():
    assert digests.blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert digests.blake3(b"abc").hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    assert len({digests.blake3(bytes(n)) for n in (63, 64, 65, 1023, 1024, 1025, 2048, 3073)}) == 8


def test_blake3_of_pieces_and_of_many():
    rng = random.Random(6)
    each = [rng.randbytes(n) for n in (0, 1, 64, 1023, 1024, 1025, 2048, 4096, 5000, 31 * 1024, 70_001)]
    whole = digests.blake3_each(each)
    assert whole == [digests.blake3(b) for b in each]
    for name in ("blake3", "xxh3", "crc32", "sha256"):
        for b, digest in zip(each, whole, strict=True):
            state, at = digests.Streamed(name), 0
            while at < len(b):
                n = rng.randint(1, 3000)
                state.update(b[at : at + n])
                at += n
            expected = {"blake3": digest, "xxh3": struct.pack("<Q", xxhash.xxh3_64_intdigest(b)), "crc32": struct.pack("<I", zlib.crc32(b)), "sha256": hashlib.sha256(b).digest()}
            assert state.digest() == expected[name]


def test_lzp_is_the_rule_position_by_position():
    """The encoder against the rule told one position after another."""

    def by_position(data):
        found, at, last = [], 0, {}
        i = fixed.LZP_CONTEXT
        while i < len(data):
            slot = int(filters._contexts(np.frombuffer(data[i - 8 : i], np.uint8))[0])
            j = last.get(slot, -1)
            last[slot] = i
            n = 0
            if j >= 0 and j + fixed.LZP_MATCH <= i:
                while n < min(len(data) - i, i - j) and data[j + n] == data[i + n]:
                    n += 1
            if n >= fixed.LZP_MATCH:
                found.append((i, n))
                i += n
            else:
                i += 1
        out, at = [struct.pack("<Q", len(data))], 0
        for start, n in found:
            out += [filters.put_varint(start - at), data[at:start], filters.put_varint(n)]
            at = start + n
        return b"".join([*out, filters.put_varint(len(data) - at), data[at:], filters.put_varint(0)])

    for b in blobs():
        if len(b) < 20_000:
            assert filters.lzp_encode(b) == by_position(b)


def blobs():
    rng = random.Random(5)
    noise = bytes(rng.randrange(256) for _ in range(8192))
    sentence = b"The quick brown fox jumps over the lazy dog, again and again. "
    mixed = [b"".join(rng.choice([b" the", b" world", noise[50:800], b"x", sentence]) for _ in range(50)) for _ in range(10)]
    return [b"", b"tiny", b"hello world", b"\xab" * 39, sentence * 20, noise, noise[:4096] + noise + noise[:4096], bytes(range(256)) * 2, b" there and the theater", b"ab" * 4000, bytes(65_537), *mixed]


@pytest.mark.parametrize("name", sorted(filters.FILTERS))
def test_filters_are_reversible(name):
    encode, decode = filters.FILTERS[name]
    assert all(decode(encode(b)) == b for b in blobs())


@pytest.mark.parametrize("name", sorted(filters.FILTERS))
@hypothesis_settings(max_examples=40, deadline=None)
@given(data=st.lists(st.sampled_from([b"a", b" the", b"\x01", b"\xff", b"0123456789" * 8, bytes(70)]), max_size=40))
def test_filters_are_reversible_on_any_mix(name, data):
    encode, decode = filters.FILTERS[name]
    assert decode(encode(b"".join(data))) == b"".join(data)


def test_filters_shrink_what_they_are_for():
    rng = random.Random(1)
    noise, gap = rng.randbytes(4096), rng.randbytes(8192)
    for name in ("rep", "srep"):
        assert len(filters.FILTERS[name][0](noise + gap + noise)) < 0.85 * (2 * 4096 + 8192)
    assert len(filters.FILTERS["lzp"][0](b"the same sentence over and over. " * 40)) < 200
    assert filters.words_encode(b" the theater of") == b"\x80 theater\x81"
    wave = b"".join(struct.pack("<H", (i * 37) & 0x7FFF) for i in range(2000))
    assert len(zlib.compress(filters.delta_encode(wave, 2))) < len(zlib.compress(wave)) / 2


def test_damaged_blocks_are_errors():
    with pytest.raises(ValueError):
        filters.rep_decode(filters.rep_encode(b"x" * 500)[:8] + b"\x00\x05\x09")
    with pytest.raises(ValueError):
        filters.get_varint(b"\xff" * 12, 0)


@pytest.mark.parametrize("level", [0, 1, 2, 3, 4])
def test_zstd(level):
    body = b"some text " * 1000
    assert codecs.zstd_decode(codecs.zstd_encode(body, level)) == body


def test_zstd_dictionary():
    samples = [(b"record %d: the quick brown fox %d jumps over the lazy dog\n" % (i, i * i)) * 40 for i in range(600)]
    made = codecs.trained_dictionary(samples, 64 << 10)
    assert made and codecs.zstd_decode(codecs.zstd_encode(samples[3], 3, dictionary=made), made) == samples[3]
    assert codecs.trained_dictionary(samples[:6], 1000) is None


@pytest.mark.parametrize("branch", [None, *fixed.BRANCH_FILTERS])
def test_lzma(branch):
    import lzma

    body = bytes(i % 251 for i in range(6000))
    assert lzma.decompress(codecs.lzma_encode(body, 5, branch)) == body


def test_recompressors_fall_back_to_plain_files():
    assert codecs.recompressed("jpeg", b"\xff\xd8...") is None
    codecs.RECOMPRESSORS["jpeg"] = (lambda b: b[::-1], lambda b: b[::-1])
    try:
        assert codecs.recompressed("jpeg", b"\xff\xd8ab") == b"ba\xd8\xff" and codecs.recompressed("jpeg", b"nope") is None
    finally:
        codecs.RECOMPRESSORS.clear()


def test_settings():
    assert [settings.zstd_level(n) for n in range(6)] == [-5, 1, 9, 15, 19, 9]
    assert settings.ppmd_settings(5) == settings.ppmd_settings(10) == (16, 256) and settings.ppmd_settings(8) == (10, 192)
    assert settings.backend(Options(level=4)) == "zstd" and settings.backend(Options(level=5)) == "lzma" and settings.backend(Options(level=9, backend="ppmd")) == "ppmd"
    assert settings.preprocessor("lzma", 2 << 30) == "srep" and settings.preprocessor("zstd", 2 << 30) == "none"
    assert settings.knobs(lambda k, d: {"lodestrata.lzma.lc": " 3 ", "lodestrata.lzma.nice": "x"}.get(k, d)) == settings.KNOBS | {"lzma.lc": 3}
    assert settings.ppmd_settings(7, order=40) == (16, 128) and settings.preproc(Options(level=5, delta=1), 2 << 30) == "none" and settings.preproc(Options(level=5), 2 << 30) == "srep"
    assert settings.parallelism(None, 1 << 20, 8) == 1 and settings.parallelism(None, 1 << 30, 8) == 8 and settings.parallelism(3, 0, 8) == 3
    assert scalars.hash_name(" XXHASH3 ") == "xxh3" and scalars.hash_name(None) == "crc32"


@pytest.mark.parametrize("bad", [Options(level=11), Options(delta=3), Options(level=5, backend="ppmd", delta=1), Options(level=5, preproc="srep", delta=1), Options(chunked=True, append=True), Options(chunked=True, delta=2), Options(lzp=True), Options(level=5, lzp=True, delta=1), Options(route=True, stdout=True), Options(route=True, split=9), Options(level=5, route=True, lzp=True)])
def test_options_that_do_not_go_together(bad):
    with pytest.raises(ValueError):
        settings.checked(bad)
