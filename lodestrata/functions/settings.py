"""Choices that are made before a plan is built: codecs, levels, threads, and which options go together."""

from __future__ import annotations

from dataclasses import dataclass

from . import fixed

MIB = 1 << 20


@dataclass(frozen=True)
class Options:
    """What a pack is asked for. preproc: rep, srep, none, or None for what the size asks for. branch: a branch filter's
    name, none, or auto for what the first entries look like. split: bytes of stored bodies beyond which a new part begins.
    long: zstd looks back further in large bodies. append and stdout belong to other calls, and are refused."""

    level: int = 3
    backend: str | None = None
    store: bool = False
    delta: int | None = None
    chunked: bool = False
    append: bool = False
    lzp: bool = False
    route: bool = False
    preproc: str | None = None
    split: int | None = None
    stdout: bool = False
    long: bool = True
    branch: str = "auto"


#: Settings of the session that stand in for fixed ones: names below "lodestrata." and their defaults (0: by level).
KNOBS = {"lzma.lc": 4, "lzma.lp": 0, "lzma.pb": 0, "lzma.nice": 273, "lzma.dict": 0, "lzma.block": 0, "ppmd.order": 0, "ppmd.mb": 0}


def knobs(get) -> dict[str, int]:
    """The knobs, by name; get(key, default) reads the session's settings. What is no number counts as not set."""
    found = {}
    for name, default in KNOBS.items():
        given = str(get(f"lodestrata.{name}", str(default))).strip()
        found[name] = int(given) if given.isdigit() else default
    return found


def zstd_level(level: int) -> int:
    return fixed.ZSTD_LEVELS.get(level, fixed.ZSTD_LEVEL_OTHERWISE)


def backend(options: Options) -> str:
    """zstd for stored and fast levels; else the one asked for; else lzma."""
    return "zstd" if options.store or options.level <= 4 else options.backend or "lzma"


def ppmd_settings(level: int, order: int = 0, mb: int = 0) -> tuple[int, int]:
    """Order and memory in MB, by level where the knobs (0: none) don't say."""
    found = fixed.PPMD_SETTINGS.get(level, fixed.PPMD_OTHERWISE)
    return min(16, max(2, order or found[0])), mb or found[1]


def preprocessor(chosen: str, total_bytes: int) -> str:
    """srep for more than a GiB under lzma or ppmd, else none."""
    return "srep" if chosen in ("lzma", "ppmd") and total_bytes > 1 << 30 else "none"


def parallelism(asked: int | None, total_bytes: int, cores: int) -> int:
    return asked or (cores if total_bytes >= 256 * MIB else 1)


def lzma_dictionary(level: int) -> int:
    return (64 if level <= 6 else 128) * MIB


def lzma_block(level: int) -> int:
    """Bytes of a block that is compressed by itself: three dictionaries."""
    return 3 * lzma_dictionary(level)


def branch_filter(name: str) -> str:
    found = name.strip().lower()
    if found not in fixed.BRANCH_FILTERS:
        raise ValueError(f"unknown branch filter: {name!r}")
    return found


def preproc(options: Options, total_bytes: int) -> str:
    """The filter that stands before the codec: the one asked for; else by size, unless another filter is asked for."""
    if options.preproc:
        return options.preproc
    other = options.delta or options.lzp or options.route or options.chunked
    return "none" if other else preprocessor(backend(options), total_bytes)


def checked(options: Options, total_bytes: int = 0) -> Options:
    """The options, if they go together; else a ValueError that says what does not."""
    chosen = backend(options)
    long_range = preproc(options, total_bytes) in ("rep", "srep")
    clashes = {
        "preproc must be rep, srep or none": options.preproc not in (None, "rep", "srep", "none"),
        "rep or srep with zstd": options.preproc in ("rep", "srep") and chosen == "zstd",
        "chunking with split output": options.chunked and options.split,
        "split must be a number of bytes": options.split is not None and options.split <= 0,
        "level must be 0 to 10": not 0 <= options.level <= 10,
        "delta stride must be 1, 2 or 4": options.delta not in (None, *fixed.DELTA_STRIDES),
        "delta with ppmd": options.delta and chosen == "ppmd",
        "delta with rep or srep": options.delta and long_range,
        "chunking with append": options.chunked and options.append,
        "chunking with delta": options.chunked and options.delta,
        "lzp with zstd": options.lzp and chosen == "zstd",
        "lzp with rep or srep": options.lzp and long_range,
        "lzp with delta": options.lzp and options.delta,
        "route with ppmd": options.route and chosen == "ppmd",
        "route with rep or srep": options.route and long_range,
        "route with lzp": options.route and options.lzp,
        "route with delta": options.route and options.delta,
        "route with stdout": options.route and options.stdout,
        "route with split output": options.route and options.split,
    }
    found = [what for what, is_so in clashes.items() if is_so]
    if found:
        raise ValueError("not supported: " + "; ".join(found))
    return options


def append_checked(meta: dict) -> dict:
    """An archive's settings, if rows can be appended under them."""
    for name in ("rep", "srep", "lzp", "delta", "chunked", "split"):
        if meta.get(name) or meta.get("preproc") == name:
            raise ValueError(f"can't append to an archive with {name}")
    if meta.get("backend") == "ppmd":
        raise ValueError("can't append to an archive with ppmd")
    return meta
