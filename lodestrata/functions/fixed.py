"""Lists, constants and names that results depend on."""

# --- fixed values: extensions by kind of content ---
JPEG_EXTENSIONS = ["jpg", "jpeg"]
PNG_EXTENSIONS = ["png", "apng"]
MEDIA_EXTENSIONS = [
    "mp4", "m4a", "m4v", "mov", "mkv", "webm", "avi", "mp3", "ogg", "opus", "flac", "aac",
    "wma", "zip", "7z", "rar", "gz", "xz", "bz2", "lz4", "zst", "pdf", "epub", "djvu",
]

# --- fixed values: extensions that the router stores without compression ---
ROUTED_EXTENSIONS = [
    "jpg", "jpeg", "png", "gif", "webp", "heic", "heif", "avif",
    "mp3", "aac", "m4a", "ogg", "opus", "flac",
    "mp4", "mkv", "webm", "mov", "avi", "flv", "wmv", "m4v",
    "zip", "gz", "xz", "7z", "rar", "bz2", "zst", "lz4", "lzma",
    "tgz", "tbz2", "txz", "tzst",
    "deb", "rpm", "apk", "jar", "war", "ear", "crx", "whl", "egg",
    "pdf",
]

# --- fixed values: entry kinds and their ids ---
ENTRY_KINDS = {"file": 0, "dir": 1, "symlink": 2, "hardlink": 3, "chunked": 4, "jpeg": 5, "png": 6}
ENTRY_TAGS = {1: "<dir>", 2: "<lnk>", 3: "<hln>", 4: "<cdc>", 5: "<pjg>", 6: "<ppg>"}
FILE_LIKE = [0, 4, 5, 6]
CONTENT_KINDS = ["Jpeg", "Png", "Media", "Other"]

# --- fixed values: content-defined chunking ---
CHUNK_MIN, CHUNK_AVG, CHUNK_MAX = 2048, 8192, 65536
CHUNK_MASK_SMALL, CHUNK_MASK_LARGE = 0x000359E3520A0000, 0x0000D90003530000
GEAR_SEED, GEAR_FACTOR, GEAR_TERM = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

# --- fixed values: byte filters ---
REP_WINDOW, SREP_WINDOW = 64, 512
REP_SLOTS, LZP_SLOTS = 1 << 24, 1 << 20
SREP_PRIME = 153191
LZP_CONTEXT, LZP_MATCH = 8, 32
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
DELTA_STRIDES = [1, 2, 4]
DICTIONARY_ESCAPE = 0x01

# --- fixed values: words of the text dictionary; word i is byte 0x80 + i, each with a blank before it ---
DICTIONARY_WORDS = (
    "the of and to in is for on that by with this at from are as "
    "you it not or be have an was your all we can will more about but "
    "they one their has what when which if my me been like its some would than "
    "these could them our out also had new just only so over back who into first "
    "because people any other very after should well where time now how before still must such "
    "said two made much then see use work many good each find year day make come "
    "most look used here down take there those even last life right think know get under "
    "between long same few through never too own while being another part does without world every"
).split()

# --- fixed values: codec settings ---
ZSTD_LEVELS = {0: -5, 1: 1, 2: 9, 3: 15, 4: 19}
ZSTD_LEVEL_OTHERWISE = 9
PPMD_SETTINGS = {7: (8, 128), 8: (10, 192), 9: (12, 192)}
PPMD_OTHERWISE = (16, 256)
HASH_NAMES = {"": "crc32", "crc32": "crc32", "crc": "crc32", "xxh3": "xxh3", "xxhash3": "xxh3", "blake3": "blake3", "b3": "blake3"}
BRANCH_FILTERS = ["x86", "arm", "armt", "ia64", "sparc", "ppc"]
