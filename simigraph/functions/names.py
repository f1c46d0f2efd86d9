"""Names and paths: parts, categories, normalisation, tokens, numbers."""

from __future__ import annotations

from collections.abc import Iterable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from simigraph.config import Normalization

# Extensions by category.
CATEGORIES = {
    "video": (".mp4", ".mkv", ".avi", ".mov", ".wmv", ".flv", ".webm", ".mpeg", ".mpg", ".m4v", ".ts", ".m2ts"),
    "audio": (".mp3", ".flac", ".wav", ".aac", ".m4a", ".wma", ".ogg", ".ape", ".opus"),
    "image": (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tiff", ".heic"),
    "document": (".txt", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".md", ".json", ".yaml", ".yml"),
}
# Extensions of the file-type presets.
PRESETS = {
    "videos": (".mp4", ".mkv", ".avi", ".mov", ".wmv", ".flv", ".webm", ".mpeg", ".mpg", ".m4v", ".ts", ".f4v", ".3gp", ".vob"),
    "images": (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tiff"),
    "documents": (".pdf", ".doc", ".docx", ".txt", ".rtf", ".xls", ".xlsx", ".csv"),
    "audio": (".mp3", ".wav", ".flac", ".aac", ".ogg", ".m4a"),
}
# Words without weight in a name.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "of", "in", "on", "at", "to", "for",
    "with", "by", "from", "as", "but", "is", "are", "was", "were", "this", "that",
)
# Patterns of tags in names.
TAG_PATTERNS = (
    r"\b(1080p|720p|2160p|1440p|4k|8k|480p|360p|240p)\b",
    r"\b(uhd|fhd|hd|sd)\b",
    r"\b(h264|h265|x264|x265|hevc|avc|divx|xvid|vp9|av1)\b",
    r"\b(bluray|blu\s*ray|bdrip|brrip|webrip|web\s*rip|webdl|web\s*dl|dvdrip|hdtv|cam|ts|tc)\b",
    r"\b(aac|mp3|dts|dd5\.1|ac3|atmos|truehd|flac|opus)\b",
    r"\b(hdr|dv|hdr10|hdr10plus|dolby\s*vision|sdr)\b",
    r"\b(rarbg|yify|yts|sparks|amiable|ettv|eztv|fgt|ion10|dimension|proper|repack)\b",
    r"\b(extended|remastered|unrated|directors?\s*cut|imax|limited|internal|readnfo)\b",
    r"\b(proper|repack|rerip|dual|audio|multi|subs?)\b",
    r"\b\d{3,4}p\b",
    r"\b\d{1,2}bit\b",
    r"\b\d+ch\b",
    r"\b\d+fps\b",
    r"\b\d+gb\b",
    r"\b\d+mb\b",
)
# Separators, hashes in names, groups at the end of names.
SEPARATORS = r"[._\-\[\](){}+=]"
HASHES = r"\b[a-f0-9]{8,64}\b|\[[a-f0-9]{6,}\]"
GROUPS = r"[-\.](yify|yts|rarbg|ettv|sparks|amiable|fgt|ion10|dimension|publichd)\b"
FOLDER_SEPARATORS = r"[._\-\[\](){}]"


# Paths


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    cut = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when((cut == "") & path.startswith("/"), F.lit("/")).when(cut == "", F.lit(".")).otherwise(cut)


def suffix(filename: Column) -> Column:
    """From the last dot, lower case; none for names whose only dot is their first or last character."""
    return F.lower(_suffix(filename))


def _suffix(filename: Column) -> Column:
    bare = F.regexp_replace(filename, r"^\.+", "")
    return F.when(bare.endswith("."), F.lit("")).otherwise(F.regexp_extract(bare, r"(?s)^.+(\.[^.]+)$", 1))


def stem(filename: Column) -> Column:
    return F.left(filename, F.length(filename) - F.length(_suffix(filename)))


def display_path(path: Column, root: str) -> Column:
    """Relative to the root's parent, else the path itself."""
    above = root.rstrip("/").rpartition("/")[0] + "/"
    return F.when(path.startswith(above), F.substr(path, F.lit(len(above) + 1))).otherwise(path)


def norm_case(path: Column) -> Column:
    """For comparing paths where case and the kind of slash don't matter."""
    return F.lower(F.translate(path, "\\", "/"))


def category(extension: Column) -> Column:
    out = F.lit("other")
    for name, known in CATEGORIES.items():
        out = F.when(F.lower(extension).isin(*known), F.lit(name)).otherwise(out)
    return out


def in_preset(extension: Column, preset: str) -> Column:
    return F.lit(True) if preset == "all" else F.lower(extension).isin(*PRESETS[preset])


def in_folders(path: Column, folders: Iterable[str], strict: bool = False) -> Column:
    """The path begins with a folder; ``strict`` asks for a slash after it."""
    out = F.lit(False)
    for f in folders:
        out = out | path.startswith(f.rstrip("/") + "/" if strict else f)
    return out


# Names


def clean_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def compiles(pattern: str) -> bool:
    """For the engine that runs it, which has a syntax of its own for some things."""
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JError, PySparkException):
        return False
    return True


def strip_patterns(text: Column, patterns: Iterable[str]) -> Column:
    """Each pattern to a blank, whatever the case; patterns that the engine can't compile are passed over."""
    for p in patterns:
        if not compiles(f"(?iU){p}"):
            continue
        text = F.regexp_replace(text, f"(?iU){p}", " ")
    return text


def normalize(filename: Column, options: Normalization) -> Column:
    """The cleaned name, before tokens are chosen."""
    s = stem(filename)
    s = F.lower(s) if options.lowercase else s
    s = F.regexp_replace(s, SEPARATORS, " ") if options.replace_separators else s
    s = strip_patterns(s, (HASHES, GROUPS)) if options.strip_hashes else s
    s = strip_patterns(s, (*TAG_PATTERNS, *options.remove_patterns))
    s = F.regexp_replace(s, r"(?U)[^\w\s]", " ") if options.remove_punctuation else s
    return clean_spaces(s)


def tokens(cleaned: Column, options: Normalization) -> Column:
    stop = STOP_WORDS if options.remove_stop_words else ()
    keep = lambda t: (t != "") & ~t.isin(*stop, "") & ((F.length(t) > 1) | t.rlike(r"^\d$"))
    return F.filter(F.split(cleaned, " "), keep)


def token_signature(tokens: Column) -> Column:
    return F.when(F.size(tokens) == 0, F.lit("")).otherwise(F.left(F.md5(F.concat_ws("|", F.array_sort(tokens))), F.lit(12)))


def length_bucket(name: Column) -> Column:
    return F.floor(F.length(name) / 5).cast("int")


def clean_folder(path: Column) -> Column:
    return clean_spaces(F.regexp_replace(F.lower(basename(parent(path))), FOLDER_SEPARATORS, " "))


# Numbers


def years(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\b(19\d{2}|20\d{2})\b"), F.lit(1)))


def _plain(number: Column) -> Column:
    """A number's digits without leading zeros."""
    return F.regexp_replace(number, r"^0+(?=\d)", "")


def episodes(text: Column) -> Column:
    low = F.lower(text)
    pair = lambda p: F.transform(F.regexp_extract_all(low, F.lit(p), F.lit(0)), lambda m: F.concat(F.lit("s"), _plain(F.regexp_extract(m, p, 1)), F.lit("e"), _plain(F.regexp_extract(m, p, 2))))
    single = F.transform(F.regexp_extract_all(low, F.lit(r"(?U)ep[isod]*\s*(\d+)"), F.lit(1)), lambda n: F.concat(F.lit("ep"), _plain(n)))
    return F.array_distinct(F.concat(pair(r"s(\d+)e(\d+)"), single, pair(r"\b(\d+)x(\d+)\b")))


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\b(\d+)\b"), F.lit(1)))


def ngrams(text: Column, n: int) -> Column:
    """Distinct runs of n characters; a shorter text is its own."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(F.when(F.length(text) < n, F.array(text)).otherwise(runs))


def char_counts(text: Column) -> Column:
    """Letters and digits with their counts, as an array of structs in order."""
    chars = F.filter(F.split(text, ""), lambda c: c.rlike(r"^[\p{L}\p{N}]$"))
    return F.transform(F.array_sort(F.array_distinct(chars)), lambda c: F.struct(c.alias("c"), F.size(F.filter(chars, lambda x: x == c)).alias("n")))


def _hundredths(size: Column, unit: int) -> Column:
    """Size in hundredths of the unit, ties to even, without the error of a quotient."""
    n = size.cast("decimal(38,0)") * 100
    rest = n % F.lit(unit).cast("decimal(38,0)")
    whole = ((n - rest) / F.lit(unit).cast("decimal(38,0)")).cast("long")
    twice = rest * 2
    up = (twice > unit) | ((twice == unit) & (whole % 2 == 1))
    return whole + up.cast("long")


def two_places(score: Column) -> Column:
    """A score from 0 to 100 to two places as its binary value says, ties to even.

    ``round`` takes the shortest decimal that stands for the double, which may
    lie on the other side of a tie.
    """
    half = F.lit(1 << 51).cast("long")

    def rounded(v: Column) -> Column:
        whole = F.floor(v)
        n = ((v - whole) * float(1 << 52)).cast("long") * 100
        k, rest = F.shiftright(n, 52), n.bitwiseAND(F.lit((1 << 52) - 1).cast("long"))
        up = (rest > half) | ((rest == half) & (k.bitwiseAND(F.lit(1).cast("long")) == 1))
        return (whole * 100 + k + up.cast("long")) / 100.0

    # As the one element of an array the score is computed once.
    return F.element_at(F.transform(F.array(score), rounded), 1)


def _two_decimals(hundredths: Column) -> Column:
    return F.concat(F.floor(hundredths / 100).cast("long").cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))


def human_size(size: Column) -> Column:
    """Two decimals and a unit from B to PB; sizes aren't negative."""
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    shown = lambda k: F.concat(_two_decimals(_hundredths(size, 1024**k)), F.lit(f" {units[k]}"))
    out = shown(len(units) - 1)
    for k in range(len(units) - 2, -1, -1):
        out = F.when(size < 1024 ** (k + 1), shown(k)).otherwise(out)
    return out


def short_size(size: Column) -> Column:
    """GB, MB, KB or bytes, with up to two decimals."""
    plain = lambda k: F.regexp_replace(F.regexp_replace(_two_decimals(_hundredths(size, 1024**k)), "0+$", ""), r"\.$", "")
    out = F.concat(size.cast("string"), F.lit(" B"))
    for unit, k in (("KB", 1), ("MB", 2), ("GB", 3)):
        out = F.when(size >= 1024**k, F.concat(plain(k), F.lit(f" {unit}"))).otherwise(out)
    return out
