import os
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import fixed, messages
from lodestrata.functions.settings import Options
from lodestrata.operators import chunking, compare, dedup, heuristics, inventory, ordering, selectors
from lodestrata.plans import archive, storage
from lodestrata.sources import manifest
from lodestrata.streaming.append import append_stream

ENTRY = "rel string, full string, kind int, is_regular boolean, size long, mtime long, ext string"


def entry(rel, size, kind=0, mtime=0, full=None):
    ext = rel.rsplit(".", 1)[1].lower() if "." in rel.strip(".").rsplit("/", 1)[-1] else ""
    return rel, full or "/" + rel, kind, kind == 0, size, mtime, ext


def reference_boundaries(body):
    """The chunking rule, a byte at a time."""
    g, ends, at, n = chunking.gear().tolist(), [], 0, len(body)
    while at < n:
        left, h, cut = n - at, 0, None
        if left <= fixed.CHUNK_MIN:
            cut = left
        else:
            for i in range(fixed.CHUNK_MIN, min(left, fixed.CHUNK_MAX)):
                h = (2 * h + g[body[at + i]]) % 2**64
                if h & (fixed.CHUNK_MASK_SMALL if i < fixed.CHUNK_AVG else fixed.CHUNK_MASK_LARGE) == 0:
                    cut = i + 1
                    break
            cut = cut or min(left, fixed.CHUNK_MAX)
        at += cut
        ends.append(at)
    return ends


def noise(seed, n):
    return random.Random(seed).randbytes(n)


@pytest.mark.parametrize("body", [b"", b"hello world", noise(1, 2048), noise(2, 2049), noise(3, 300_000), bytes(200_000), b"ab" * 60_000])
def test_chunk_rule(body):
    assert chunking.boundaries(body) == reference_boundaries(body)


def test_chunks_find_their_way_back_after_an_insertion():
    a = noise(9, 300_000)
    b = b"\xaa" * 7 + a

    def cut(x):
        ends = chunking.boundaries(x)
        return {x[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)}

    assert len(cut(a) & cut(b)) >= len(cut(a)) / 2
    assert all(fixed.CHUNK_MIN <= len(c) <= fixed.CHUNK_MAX for c in cut(a) if c != a[chunking.boundaries(a)[-2] :])


def test_registry_and_reassembly(spark):
    a = noise(4, 100_000)
    rows = [("a", a), ("b", b"PRE" + a + b"POST"), ("c", a[:50_000] + b"x" * 47 + a[50_000:]), ("d", b"short"), ("e", b"")]
    chunks = chunking.chunked(spark.createDataFrame(rows, "rel string, body binary")).cache()
    known = chunking.registry(chunks).cache()
    assert sorted(r.chunk_id for r in known.collect()) == list(range(chunks.select("hash").distinct().count()))
    made = {r.path: bytes(r.body) for r in chunking.reassembled(chunking.recipes(chunks, known), known).collect()}
    assert made == {k: v for k, v in rows if v}
    lost = {r.path: r.body for r in chunking.reassembled(chunking.recipes(chunks, known), known.where("chunk_id > 0")).collect()}
    assert lost["a"] is None and bytes(lost["d"]) == b"short"
    assert chunking.savings(chunks).first().saved > 0.4


@pytest.mark.parametrize("sizes, p50, p95", [([], 0, 0), ([42], 42, 42), ([1, 2, 3, 4, 5], 3, 5), (list(range(1, 21)), 10, 19)])
def test_percentiles(spark, sizes, p50, p95):
    df = spark.createDataFrame([entry(f"f{i}", s) for i, s in enumerate(sizes)], ENTRY)
    assert tuple(inventory.percentiles(df).first()) == (p50, p95)


def test_empty_inventory(spark):
    none = spark.createDataFrame([], ENTRY)
    assert inventory.totals(none).first().asDict() == {"files": 0, "dirs": 0, "symlinks": 0, "unreadable": 0, "bytes": 0}
    assert {r.content: r.files for r in inventory.by_category(none).collect()} == {"Png": 0, "Jpeg": 0, "Media": 0, "Other": 0}
    assert inventory.scan_summary(none).first().total_bytes == 0 and inventory.media_share(none).first().share == 0.0
    assert ordering.route(none).count() == 0 and ordering.solid_position(none).count() == 0


def test_selectors_pass_folders(spark):
    df = spark.createDataFrame([entry("d", 0, 1), entry("d/a.txt", 10, mtime=-5), entry("d/b.txt", 5000, mtime=2_000)], ENTRY)
    names = lambda s: [r.rel for r in selectors.select(df, s).orderBy("rel").collect()]
    assert names(selectors.Selection(min_size=100)) == ["d", "d/b.txt"]
    assert names(selectors.Selection(date_from=0, date_to=1_000)) == ["d", "d/a.txt"]
    assert names(selectors.Selection(exclude=["a.t"])) == ["d", "d/b.txt"] and names(selectors.Selection(exclude=["A.T"])) == ["d", "d/a.txt", "d/b.txt"]
    assert selectors.find(df, ["B.TXT"]).count() == 1


def test_duplicates_are_linked_to_the_first_in_order(spark):
    rows = [entry("b/x.txt", 3), entry("a/x.txt", 3), entry("c/y.txt", 3), entry("e1", 0), entry("e2", 0)]
    body = F.when(F.col("rel").endswith("x.txt"), "same").otherwise(F.col("rel"))
    df = spark.createDataFrame(rows, ENTRY)
    assert [(r.rel, r.canonical_rel) for r in dedup.duplicates(df, F.md5(body)).collect()] == [("b/x.txt", "a/x.txt")]


def test_tally_names_the_damaged(spark):
    rows = [(f"f{i:03d}", 0, 1, i % 4 != 0) for i in range(100)] + [("d", 1, 0, None)]
    got = inventory.test_tally(spark.createDataFrame(rows, "rel string, kind int, size long, ok boolean")).first()
    assert (got.entries, got.verified, got.failed, got.more) == (101, 75, 25, 5) and got.failed_paths[0] == "f000" and len(got.failed_paths) == 20


def test_compare_folder_and_empty_file_match(spark):
    a = spark.createDataFrame([("x", 0, 0), ("y", 1, 5)], "rel string, size long, crc32 long")
    b = spark.createDataFrame([("x", 0, 0), ("z", 1, 5)], "rel string, size long, crc32 long")
    assert {r.rel: r.status for r in compare.compare(a, b).collect()} == {"x": "match", "y": "only<A", "z": "only>B"}


def test_executables(spark):
    elf = b"\x7fELF" + bytes(14) + b"\x3e\x00" + bytes(9)
    rows = [(f"f{i}", 0, True, b, len(b), "") for i, b in enumerate([elf, b"MZ" + bytes(30), bytes(30), bytes(30), b"MZ"])]
    got = heuristics.executable(spark.createDataFrame(rows, "rel string, kind int, is_regular boolean, body binary, size long, ext string")).first()
    assert (got.samples, got.hits, got.branch) == (4, 2, "x86")


def test_split_resets_behind_each_part(spark):
    writes = spark.createDataFrame(list(enumerate([60, 60, 10, 200, 5])), "position long, size long")
    assert [r.part for r in ordering.split_parts(writes, 100).orderBy("position").collect()] == [1, 1, 2, 2, 3]


@pytest.fixture
def tree(tmp_path):
    src = tmp_path / "src"
    (src / "nested/deep").mkdir(parents=True)
    (src / "hello.txt").write_bytes(b"Hello, world!\n")
    (src / "nested/a.bin").write_bytes(bytes(i % 251 for i in range(2048)))
    (src / "nested/deep/b.bin").write_bytes(b"abcdefgh" * 4096)
    (src / "empty").write_bytes(b"")
    (src / ".hidden").write_bytes(b"dot")
    (src / "zeros.bin").write_bytes(bytes(65_537))
    (src / "copy.bin").write_bytes(bytes(65_537))
    (src / "image.jpg").write_bytes(b"\xab" * 90_000)
    os.symlink("hello.txt", src / "link")
    os.utime(src / "hello.txt", (1584286200, 1584286200))
    return src


def same_tree(a, b):
    seen = lambda root: {os.path.relpath(os.path.join(d, n), root): os.readlink(p) if os.path.islink(p := os.path.join(d, n)) else open(p, "rb").read() if os.path.isfile(p) else None for d, dirs, files in os.walk(root) for n in dirs + files}  # noqa: E731, SIM115
    return seen(a) == seen(b)


@pytest.mark.parametrize("options, algo", [(Options(), "crc32"), (Options(level=1), "xxh3"), (Options(level=5), "blake3"), (Options(store=True), None), (Options(delta=2), "crc32"), (Options(level=5, lzp=True), "crc32"), (Options(route=True), "crc32"), (Options(chunked=True), "crc32"), (Options(level=5, preproc="srep"), "blake3"), (Options(level=5, preproc="rep", branch="x86"), None), (Options(split=1000), "xxh3"), (Options(store=True, split=40_000), "crc32")])
def test_archive_round_trip(spark, tree, tmp_path, options, algo):
    path, out = f"file://{tmp_path}/archive", tmp_path / "out"
    archive.pack(manifest.with_bodies(manifest.manifest(spark, [str(tree)])), path, options, algo)
    tally = archive.test(spark, path).first()
    assert tally.failed == 0 and tally.verified == 8 - 1
    assert archive.entries(spark, path).where("kind = 3").count() == 1
    out.mkdir()
    archive.extract(spark, path, str(out))
    assert same_tree(tree, out / "src") and int(os.stat(out / "src/hello.txt").st_mtime) == 1584286200
    assert archive.totals(spark, path).first().bytes > 0 and archive.listing(spark, path, ["HELLO"]).count() == 1


def test_archive_append_and_verify(spark, tree, tmp_path):
    path = f"file://{tmp_path}/archive"
    archive.pack(manifest.with_bodies(manifest.manifest(spark, [str(tree)])), path)
    more = tmp_path / "appended"
    more.mkdir()
    (more / "one.txt").write_bytes(b"I was appended!\n")
    before = set(os.listdir(tmp_path / "archive/entries"))
    assert archive.append(manifest.with_bodies(manifest.manifest(spark, [str(more)])), path) == 1
    assert before < set(os.listdir(tmp_path / "archive/entries")) and archive.test(spark, path).first().failed == 0
    (tree / "hello.txt").write_bytes(b"changed")
    os.remove(tree / "zeros.bin")
    got = {r.rel: r.status for r in archive.verify(spark, path, str(tree.parent)).collect()}
    assert got["src/hello.txt"] == "diff" and got["src/zeros.bin"] == "miss" and got["src/nested/a.bin"] == "ok"
    assert got["src"] == got["src/link"] == got["src/copy.bin"] == "ok"
    bad = Options(level=5, lzp=True)
    archive.pack(manifest.with_bodies(manifest.manifest(spark, [str(more)])), path, bad)
    with pytest.raises(ValueError):
        archive.append(manifest.with_bodies(manifest.manifest(spark, [str(more)])), path)


def test_attributes_images_and_dictionaries(spark, tree, tmp_path):
    from lodestrata.functions import codecs

    (tree / "real.jpg").write_bytes(b"\xff\xd8" + b"picture" * 50)
    (tree / "bad.png").write_bytes(b"\x89PNG" + b"broken" * 50)
    for i in range(40):
        (tree / f"r{i}.log").write_bytes((b"record %d: the quick brown fox jumps %d times\n" % (i, i * i)) * 900)
    try:
        os.setxattr(tree / "hello.txt", "user.test", b"value")
        has_attributes = True
    except OSError:
        has_attributes = False
    path, out, said = f"file://{tmp_path}/archive", tmp_path / "out", []

    def broken(b):
        raise ValueError("no")

    codecs.RECOMPRESSORS.update(jpeg=(lambda b: b[::-1], lambda b: b[::-1]), png=(broken, lambda b: b))
    try:
        archive.pack(manifest.with_bodies(manifest.manifest(spark, [str(tree)])), path, dictionary=True, done=lambda *a: said.append(a))
        assert {r.rel: r.kind for r in archive.entries(spark, path).where("rel LIKE '%real.jpg' OR rel LIKE '%bad.png'").collect()} == {"src/real.jpg": 5, "src/bad.png": 0}
        assert archive.meta(spark, path)["dictionary"] and said == [(path, "ok")] and archive.test(spark, path).first().failed == 0
        out.mkdir()
        archive.extract(spark, path, str(out))
    finally:
        codecs.RECOMPRESSORS.clear()
    assert same_tree(tree, out / "src")
    assert not has_attributes or os.getxattr(out / "src/hello.txt", "user.test") == b"value"


def test_unsafe_paths_are_not_extracted(spark, tmp_path):
    rows = [("../evil", "/x", 0, True, 1, 0, "", 420, "", b"x")]
    df = spark.createDataFrame(rows, ENTRY + ", mode long, link_target string, body binary")
    archive.pack(df, f"file://{tmp_path}/bad")
    with pytest.raises(ValueError):
        archive.extract(spark, f"file://{tmp_path}/bad", str(tmp_path / "out"))


def test_stream_appends_batches(spark, tree, tmp_path):
    path = f"file://{tmp_path}/archive"
    entries = manifest.with_bodies(manifest.manifest(spark, [str(tree)]))
    archive.pack(entries, path)
    entries.write.parquet(f"file://{tmp_path}/incoming")
    stream = spark.readStream.schema(spark.read.parquet(f"file://{tmp_path}/incoming").schema).parquet(f"file://{tmp_path}/incoming")
    append_stream(stream, path, f"file://{tmp_path}/checkpoint").awaitTermination()
    assert {r.batch for r in archive.entries(spark, path).select("batch").distinct().collect()} == {0, 1}


def test_sources(spark, tree, tmp_path):
    found = {r.rel: r for r in manifest.manifest(spark, [str(tree)]).collect()}
    assert found["src"].kind == 1 and found["src/.hidden"].size == 3 and found["src/empty"].size == 0 and found["src/link"].kind == 2
    assert {r.rel for r in manifest.manifest(spark, [str(tree / "*.bin")]).collect()} == {"zeros.bin", "copy.bin"}
    with pytest.raises(FileNotFoundError):
        manifest.manifest(spark, [str(tree / "*.nothing")])
    (tmp_path / "list").write_text("# comment\n\n  /a/b  \n/c\n")
    assert [r.path for r in manifest.listed(spark, str(tmp_path / "list")).collect()] == ["/a/b", "/c"]
    prints = {r.rel: (r.size, r.crc32) for r in manifest.fingerprints(spark, str(tree)).collect()}
    assert prints["nested"] == (0, 0) and prints["empty"] == (0, 0) and prints["hello.txt"][0] == 14
    for k in (1, 2):
        (tmp_path / f"whole.{k:03d}").write_bytes(b"x")
    assert len(manifest.parts(str(tmp_path / "whole"))) == 2


# --- what must hold at any size ---


def test_numbers_are_gapless_at_any_size(spark):
    """Many rows, more ranges than tasks, and a wide column that only some branches of a plan read."""
    n, before = 1_000_000, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows = spark.range(n).select(F.concat(F.lit("d"), (F.col("id") % 97).cast("string"), F.lit("/"), F.sha1(F.col("id").cast("string"))).alias("rel"), F.lit(0).alias("kind"), F.lit("").alias("ext"), (F.col("id") % 7).alias("size"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
        placed = ordering.solid_position(rows)
        assert tuple(placed.agg(F.count("*"), F.count_distinct("position"), F.min("position"), F.max("position"), F.count_distinct("wide")).first()) == (n, n, 0, n - 1, n)
        chunks = spark.range(n).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.lit(0).alias("seq"), F.lit(0).cast("long").alias("offset"), F.lit(6).alias("len"), F.sha1((F.col("id") % 600_000).cast("string")).alias("hash"), (F.col("id") % 600_000).cast("string").cast("binary").alias("payload"))
        known = storage.settled(chunking.registry(chunks), "registry")
        assert tuple(known.agg(F.count("*"), F.count_distinct("chunk_id"), F.max("chunk_id")).first()) == (600_000, 600_000, 599_999)
        back = chunking.reassembled(chunking.recipes(chunks, known), known)
        assert tuple(back.agg(F.count("*"), F.sum("dangling"), F.count_if(F.expr("cast(body AS string) <> cast(cast(substring(path, 2) AS long) % 600000 AS string)"))).first()) == (n, 0, 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_order_of_positions(spark):
    rng = random.Random(4)
    rows = [entry(f"{rng.choice('aB')}/{rng.choice('cD')}{i}.{rng.choice(['txt', 'MD', 'x'])}", rng.randrange(4), rng.choice([0, 0, 1, 2])) for i in range(500)]
    got = {r.rel: r.position for r in ordering.solid_position(spark.createDataFrame(rows, ENTRY)).collect()}
    key = lambda r: ({1: 0, 2: 1}.get(r[2], 2), r[6], r[0].rsplit("/", 1)[0].lower(), r[4], r[0].lower(), r[0])
    assert got == {r[0]: k for k, r in enumerate(sorted(rows, key=key))}


@pytest.mark.parametrize("limit", [1, 50, 900, 10**9])
def test_split_is_the_fold(spark, limit):
    rng = random.Random(limit)
    sizes = [rng.choice([0, 1, 30, 200, 2000]) for _ in range(3000)]
    part, grown, expected = 1, 0, []
    for n in sizes:
        expected.append(part)
        grown += n
        if grown > limit:
            part, grown = part + 1, 0
    writes = spark.createDataFrame([(k + 1, n) for k, n in enumerate(sizes)], "position long, size long").repartition(5)
    assert [r.part for r in ordering.split_parts(writes, limit).orderBy("position").collect()] == expected
    assert ordering.split_parts(writes.limit(0), limit).count() == 0


def test_a_hot_key_is_cut(spark, monkeypatch):
    monkeypatch.setattr(storage, "HOT", 50)
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 40}") for i in range(2000)] + [(9999, "none")], "id long, key string")
    table = spark.createDataFrame([("hot", 1), *((f"k{i}", i) for i in range(40))], "key string, v int")
    for how in ("inner", "left"):
        got = sorted(map(tuple, storage.joined(rows, table, ["key"], how).select("id", "key", "v").collect()))
        assert got == sorted(map(tuple, rows.join(table, "key", how).select("id", "key", "v").collect()))


def test_contents_without_a_digest_are_equal_to_nothing(spark):
    rows = spark.createDataFrame([entry("a", 5), entry("b", 5), entry("c", 7), entry("d", 7)], ENTRY)
    digest = F.when(F.col("size") == 7, "same")
    assert [r.keep for r in dedup.groups(rows, digest).collect()] == ["c"]
    assert {r.rel for r in dedup.members(rows, digest).collect()} == {"c", "d"} and dedup.duplicates(rows, digest).count() == 1
    a = spark.createDataFrame([("x", 0, 1, None, None), ("y", 0, 1, 5, None), ("d", 1, 0, None, None)], "rel string, kind int, size long, crc32 long, stored_crc32 long")
    live = spark.createDataFrame([("x", 1, 5), ("y", 1, None), ("d", 0, 0)], "rel string, size long, crc32 long")
    assert {r.rel: r.status for r in compare.verify(a, live).collect()} == {"x": "diff", "y": "diff", "d": "ok"}
    assert {r.rel: r.status for r in compare.compare(a.where("kind = 0"), live).collect()} == {"x": "differ", "y": "differ", "d": "only>B"}


def test_a_chunk_that_is_not_known_dangles(spark):
    chunks = spark.createDataFrame([("a", 0, 0, 1, "h1", b"x"), ("a", 1, 1, 1, "h2", b"y"), ("b", 0, 0, 1, "h2", b"y")], chunking.CHUNKS)
    known = chunking.registry(chunks).where("hash = 'h1'")
    got = {r.path: (r.dangling, r.body) for r in chunking.reassembled(chunking.recipes(chunks, known), known).collect()}
    assert got == {"a": (1, None), "b": (1, None)}


@pytest.mark.parametrize("options, algo", [(Options(level=1), "blake3"), (Options(level=1, chunked=True), "xxh3"), (Options(store=True, delta=4), None)])
def test_large_files_go_in_pieces(spark, tree, tmp_path, options, algo):
    path, out = f"file://{tmp_path}/archive", tmp_path / "out"
    (tree / "large.bin").write_bytes(noise(6, 100_001))
    (tree / "large too.bin").write_bytes(noise(6, 100_001))
    rows = manifest.with_bodies(manifest.manifest(spark, [str(tree)]), piece=10_000)
    archive.pack(rows, path, options, algo)
    stored = archive.entries(spark, path)
    assert stored.where("rel LIKE '%large%' AND kind = 3").count() == 1 and stored.where("rel LIKE '%large%' AND kind = 0").first().pieces == 11
    assert archive.test(spark, path).first().failed == 0 and archive.verify(spark, path, str(tmp_path)).where("status <> 'ok'").count() == 0
    out.mkdir()
    archive.extract(spark, path, str(out))
    assert same_tree(tree, out / "src")


def test_missing_bodies_are_errors(spark, tree, tmp_path):
    path, every = f"file://{tmp_path}/archive", manifest.manifest(spark, [str(tree)])
    os.remove(tree / "copy.bin")
    (tree / "image.jpg").write_bytes(b"shorter")
    rows = manifest.with_bodies(every)
    assert {r.rel for r in rows.where("is_regular AND body IS NULL").collect()} == {"src/copy.bin", "src/image.jpg"}
    with pytest.raises(ValueError, match="can't be read"):
        archive.pack(rows, path)
    assert not os.path.exists(tmp_path / "archive")
    archive.pack(rows.where("body IS NOT NULL OR NOT is_regular"), path, Options(level=1))
    folder = next((tmp_path / "archive/bodies").iterdir())
    kept = spark.read.parquet(f"file://{folder}").where("rel NOT LIKE '%.hidden'").collect()
    schema = spark.read.parquet(f"file://{folder}").schema
    spark.createDataFrame(kept, schema).write.mode("overwrite").parquet(f"file://{folder}")
    assert archive.test(spark, path).first().failed_paths == ["src/.hidden"]
    with pytest.raises(Exception, match="no whole body of src/.hidden"):
        archive.extract(spark, path, str(tmp_path / "out"))


def test_batches_count_from_the_moment_they_are_named(spark, tree, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/archive"
    rows = manifest.with_bodies(manifest.manifest(spark, [str(tree / "*.txt")]))
    archive.pack(rows, path, Options(level=1))
    own = archive._commit
    monkeypatch.setattr(archive, "_commit", lambda *a: 1 / 0)
    for again in (lambda: archive.append(rows, path), lambda: archive.pack(rows, path)):
        with pytest.raises(ZeroDivisionError):
            again()
        assert archive.entries(spark, path).count() == 1 and archive.bodies(spark, path).count() == 1
    monkeypatch.setattr(archive, "_commit", own)
    assert archive.append(rows, path, token="t#4") == 1 and archive.append(rows, path, token="t#4") == 1
    # another writer has taken the next number, and never came to its end
    (tmp_path / "archive/meta/batch-000002.taken").touch()
    assert archive.append(rows, path) == 3 and archive.entries(spark, path).count() == 3
    assert [b["batch"] for b in archive.batches(spark, path)] == [0, 1, 3]
    monkeypatch.setattr(archive, "_move", lambda spark, made, to, own=archive._move: 1 / 0 if ".tmp-" in made else own(spark, made, to))
    with pytest.raises(ZeroDivisionError):  # the new one can't be moved into place; the old one comes back
        archive.pack(rows, path)
    assert archive.entries(spark, path).count() == 3


def test_other_formats_are_refused(spark, tree, tmp_path):
    path = f"file://{tmp_path}/archive"
    with pytest.raises(FileNotFoundError):
        archive.entries(spark, path)
    archive.pack(manifest.with_bodies(manifest.manifest(spark, [str(tree / "hello.txt")])), path, Options(level=1))
    at = tmp_path / "archive/meta/batch-000000.json"
    good = at.read_text()
    for old, new in (("archive 2", "archive 1"), ('"zstd"', '"brotli"'), ('"crc32"', '"md5"')):
        at.write_text(good.replace(old, new))
        (tmp_path / "archive/meta/.batch-000000.json.crc").unlink(missing_ok=True)
        with pytest.raises(ValueError):
            archive.entries(spark, path)


def test_parts_replace_what_was_there(spark, tree, tmp_path):
    path, out = f"file://{tmp_path}/archive", tmp_path / "out"
    rows = manifest.with_bodies(manifest.manifest(spark, [str(tree)]))
    archive.pack(rows, path, Options(level=1))
    made = archive.pack(rows, path, Options(store=True, split=20_000))
    assert made["parts"] == len(manifest.parts(str(tmp_path / "archive"))) == 4 and not (tmp_path / "archive").exists()
    assert archive.test(spark, path).first().failed == 0
    with pytest.raises(ValueError):
        archive.append(rows, path)
    assert archive.pack(rows, path, Options(store=True, split=70_000))["parts"] == 3 and not (tmp_path / "archive.004").exists()
    out.mkdir()
    archive.extract(spark, path, str(out))
    assert same_tree(tree, out / "src")
    archive.pack(rows, path, Options(level=1))
    assert archive.roots(spark, path) == [path] and not (tmp_path / "archive.001").exists()


def test_counters_knobs_and_messages(spark, tree, tmp_path):
    path, said = f"file://{tmp_path}/archive", messages.Messages()
    (tree / "twice.bin").write_bytes(noise(3, 3_000_000))
    rows = manifest.with_bodies(manifest.manifest(spark, [str(tree)]))
    got = archive.pack(rows, path, Options(level=1, branch="arm"), messages=said)
    assert got["entries"] == archive.entries(spark, path).count() and got["stored"] >= 3_000_000 and got["bytes"] > got["stored"] // 2 and said.warnings == 1
    assert said.error("no") == "00001! no" and said.warning("hm") == "00002: hm"
    spark.conf.set("lodestrata.lzma.block", "1")
    try:
        archive.pack(rows, path, Options(level=5))
    finally:
        spark.conf.unset("lodestrata.lzma.block")
    assert archive.meta(spark, path)["knobs"]["lzma.block"] == 1 and archive.test(spark, path).first().failed == 0


def test_the_walk_goes_on_in_tasks(spark, tree, monkeypatch):
    whole = sorted(map(tuple, manifest.manifest(spark, [str(tree)]).drop("xattrs").collect()), key=str)
    monkeypatch.setattr(manifest, "OPENED", 1)
    assert sorted(map(tuple, manifest.manifest(spark, [str(tree)]).drop("xattrs").collect()), key=str) == whole
    far = {r.rel: (r.size, bytes(r.body)) for r in manifest.remote(spark, f"file://{tree}").select("rel", "size", "body").collect()}
    assert far["nested/deep/b.bin"] == (32_768, b"abcdefgh" * 4096) and far["hello.txt"][1] == b"Hello, world!\n" and len(far) >= 6


@pytest.mark.parametrize("bad", [Options(append=True), Options(stdout=True), Options(chunked=True, split=5), Options(preproc="srep"), Options(level=5, preproc="zip"), Options(level=5, backend="ppmd"), Options(level=5, branch="z80"), Options(split=0)])
def test_options_that_a_pack_refuses(spark, tree, tmp_path, bad):
    with pytest.raises(ValueError):
        archive.pack(manifest.with_bodies(manifest.manifest(spark, [str(tree / "hello.txt")])), f"file://{tmp_path}/archive", bad)
