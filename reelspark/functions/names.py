"""Names and texts as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.functions.timecode import two

#: Shapes of folders named by a day.
DAY_FOLDER = r"^(?:[0-9]{2}Y[0-9]{2}M[0-9]{2}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[.-][0-9]{1,2}[.-][0-9]{2})$"
TAKE_NAME = r"^(.+?)-?T([0-9]{2,3})(_[^.]*)?$"
TAKE_ENDINGS = r"(?i)_(?:ISO|LR|MIX|X1|X2)$"
UNSAFE = r'[\\/:*?"<>|\x00-\x1f]'


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def normalized(name: Column) -> Column:
    """Lower-case letters and digits alone."""
    return F.regexp_replace(F.lower(name), "[^0-9a-z]", "")


def digit_runs(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit("([0-9]+)"), F.lit(1))


def natural_key(text: Column) -> Column:
    """Sorts digit runs as numbers and before text: an array of (is text, number, text)."""
    runs = F.regexp_extract_all(text, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.transform(runs, lambda r: F.struct((~r.rlike("^[0-9]")).cast("int").alias("kind"), F.coalesce(r.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias("number"), F.when(r.rlike("^[0-9]"), "").otherwise(F.lower(r)).alias("text")))


def natural_text(text: Column) -> Column:
    """As natural_key in one text that sorts as plain text: a number is its length and its digits, other
    text ends below all characters."""
    runs = F.regexp_extract_all(text, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    digits = lambda r: F.regexp_replace(r, "^0+(?=[0-9])", "")
    number = lambda r: F.concat(F.lit("0"), F.lpad(F.length(digits(r)).cast("string"), 6, "0"), digits(r))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), number(r)).otherwise(F.concat(F.lit("1"), F.lower(r), F.lit("\x00")))), "")


def safe_part(text: Column, with_: str = "-") -> Column:
    """A path component: unsafe characters replaced, no outer blanks, no dots at the end, never '.' or '..'."""
    clean = F.trim(F.regexp_replace(text, UNSAFE, with_))
    return F.regexp_replace(F.regexp_replace(clean, r"[. ]+$", ""), r"^\.{1,2}$", "")


def expand(pattern: str, values: dict[str, Column], fallbacks: dict[str, str] | None = None, number: Column | None = None, for_path: bool = True) -> Column:
    """Compiles "{scene}T{take} {n:3}" to a concatenation; unknown tokens stay as they are."""
    out: list[Column] = []
    for literal, token, width in re.findall(r"([^{]+|\{(?!\w+(?::\d+)?\}))|\{(\w+)(?::(\d+))?\}", pattern):
        if literal:
            out.append(F.lit(literal))
        elif token == "n":
            out.append(two(number if number is not None else F.lit(1), int(width or 1)))
        elif token in values:
            value = F.coalesce(values[token].cast("string"), F.lit(""))
            value = safe_part(value) if for_path else value
            spare = (fallbacks or {}).get(token, "")
            out.append(F.coalesce(F.nullif(value, F.lit("")), F.lit(spare)) if for_path and spare else value)
        else:
            out.append(F.lit("{" + token + (f":{width}" if width else "") + "}"))
    return F.concat(*out) if out else F.lit("")


def find_replace(text: Column, find: str, replace: str, regex: bool = False, case_sensitive: bool = True) -> Column:
    """Literal or regular expression; back references are written \\1. A bad expression raises ValueError."""
    if not find:
        return text
    if regex:
        try:
            re.compile(find)
        except re.error as e:
            raise ValueError(str(e)) from e
    shape = find if regex else rf"\Q{find}\E"
    new = re.sub(r"\\(\d)", r"$\1", replace.replace("$", r"\$")) if regex else re.sub(r"([\\$])", r"\\\1", replace)
    return F.regexp_replace(text, F.lit(("" if case_sensitive else "(?i)") + shape), F.lit(new))


def name_problem(name: Column) -> Column:
    """Why a file name can't be used, or null."""
    return (
        F.when(F.trim(name) == "", "blank")
        .when(name.isin(".", ".."), "dots")
        .when(name.contains("/"), "slash")
        .when(name.contains("\x00"), "nul")
        .when(F.octet_length(name) > 255, "too long")
        .when(name.rlike(r'[\\:*?"<>|\x01-\x1f]'), "unsafe character")
        .when(name.rlike(r"[. ]$"), "dot or blank at the end")
        .when(stem(F.upper(name)).rlike(r"^(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"), "reserved")
    )


def take_parts(name: Column) -> Column:
    """struct<scene, take, ending, ext> of a take's file name; empty where it isn't one."""
    bare = stem(name)
    parts = [F.regexp_extract(bare, TAKE_NAME, k).alias(x) for k, x in ((1, "scene"), (2, "take"), (3, "ending"))]
    return F.struct(*parts, F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("ext"))


def renamed_take(name: Column, scene: Column, take: Column) -> Column:
    """The take's file name after a change of scene or take; separator, ending and extension stay."""
    p, bare = take_parts(name), stem(name)
    dash = F.when(bare.rlike(r"^.+?-T[0-9]{2,3}(?:_[^.]*)?$"), "-T").otherwise("T")
    number = F.lpad(take, F.greatest(F.length(p["take"]), F.length(take)), "0")
    return F.when(p["take"] == "", name).otherwise(F.concat(scene, dash, number, p["ending"], p["ext"]))


def take_stem(name: Column) -> Column:
    """What the files of one take have in common in their names."""
    return F.regexp_replace(F.lower(stem(name)), TAKE_ENDINGS, "")


def recorder_label(recorder: Column) -> Column:
    """'SoundDev: 833 SN' is a Sound Devices 833; others as they are; none is unknown."""
    model = F.regexp_extract(recorder, r"^SoundDev:?\s*(\S+)", 1)
    return F.when(model != "", F.concat(F.lit("Sound Devices "), model)).when(F.coalesce(recorder, F.lit("")) == "", "Unknown recorder").otherwise(recorder)


def human_size(size: Column) -> Column:
    """Decimal units: '12 B', '3.4 kB', '5.6 GB'."""
    steps = [(1e12, "TB"), (1e9, "GB"), (1e6, "MB"), (1e3, "kB")]
    out = F.format_string("%d B", size.cast("long"))
    for least, unit in reversed(steps):
        out = F.when(size >= least, F.format_string(f"%.1f {unit}", size / least)).otherwise(out)
    return out


def human_time(seconds: Column) -> Column:
    """'45 s', '3 min 20 s', '2 h 05 min'."""
    s = F.floor(seconds + 0.5).cast("long")
    minutes = F.floor(s / 60).cast("long")
    return F.when(s < 60, F.format_string("%d s", s)).when(s < 3600, F.format_string("%d min %d s", minutes, s % 60)).otherwise(F.format_string("%d h %02d min", F.floor(s / 3600).cast("long"), minutes % 60))


def format_db(db: Column, off: float = -60.05) -> Column:
    """'+3.0 dB', '-12.5 dB', '0.0 dB'; '-inf' where a fader is off."""
    shown = F.when(F.abs(db) < 0.05, "0.0 dB").otherwise(F.format_string("%+.1f dB", db))
    return F.when(db <= off, "-inf").otherwise(shown)


def format_pan(pan: Column) -> Column:
    """'C', 'L30' or 'R100' of -1 to 1."""
    share = F.bround(pan * 100).cast("int")
    return F.when(share == 0, "C").when(share < 0, F.concat(F.lit("L"), (-share).cast("string"))).otherwise(F.concat(F.lit("R"), share.cast("string")))


def forward(path: Column) -> Column:
    """The path with forward slashes."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def clip_order(path: Column) -> Column:
    """The order of video clips: by path, whatever the case."""
    return F.lower(path)


def is_take_file(name: Column) -> Column:
    """A file of a take's tracks or of its mix, which are kept together."""
    return stem(name).rlike("(?i)_(?:ISO|LR)$")


def looks_stereo(tracks: Column, name: Column) -> Column:
    """Two tracks that are a left and a right: by the file's name, or names that differ in a last l and r."""
    low = F.transform(tracks, lambda x: F.lower(F.trim(x)))
    a, b = F.get(low, F.lit(0)), F.get(low, F.lit(1))
    sides = F.concat_ws("|", a, b).isin("l|r", "left|right", "mix l|mix r", "mixl|mixr")
    ends = (F.length(a) > 0) & (F.regexp_replace(a, ".$", "") == F.regexp_replace(b, ".$", "")) & a.endswith("l") & b.endswith("r")
    return (F.size(tracks) == 2) & (stem(name).rlike("(?i)_LR$") | sides | ends)


def report_name(project: Column, first_day: Column, last_day: Column) -> Column:
    """A report's file name: its project and its day, or its first and last one."""
    known = lambda x: F.coalesce(x, F.lit("")) != ""
    days = F.when(~known(first_day), "").when(first_day == last_day, F.concat(F.lit(" "), first_day)).otherwise(F.concat(F.lit(" "), first_day, F.lit(" to "), last_day))
    return F.trim(F.regexp_replace(F.concat(F.when(known(project), project).otherwise("Sound"), F.lit(" Sound Report"), days), r'[/\\:*?"<>|]', "-"))


def copy_ending(platform: Column) -> Column:
    """What the name of a copy for a platform ends in: its name before a bracket, letters and digits alone."""
    return F.concat(F.lit("_"), F.regexp_replace(F.split_part(platform, F.lit(" ("), F.lit(1)), "[^A-Za-z0-9]", ""))


def combined_name(scene: Column, take: Column, original: Column, parts: Column, ext: Column, taken: Column) -> Column:
    """The name of a file of several: that of the take they came from, else of scene and take; with the
    parts' names behind it where it is taken, and those alone where there is neither."""
    s, t = F.trim(scene), F.trim(take)
    core = F.regexp_replace(F.coalesce(original, F.lit("")), r"(?i)(?:_[^.]*)?\.[^.]*$", "")
    own = F.lower(F.regexp_replace(core, r"[-_ ]", "")) == F.lower(F.concat(F.regexp_replace(s, r"[-_ ]", ""), F.lit("t"), F.regexp_replace(t, r"[-_ ]", "")))
    base = F.when((s == "") | (t == ""), core).when(own, core).otherwise(safe_part(F.concat(s, F.lit("T"), t)))
    joined = F.array_join(parts, "+")
    return F.when(base == "", F.concat(joined, ext)).when(F.array_contains(taken, F.concat(base, ext)), F.concat(base, F.lit("_"), joined, ext)).otherwise(F.concat(base, ext))


def html_escaped(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def url_quoted(path: Column) -> Column:
    """Percent-encoded, with / and : kept."""
    out = F.url_encode(path)
    for old, new in (("+", "%20"), ("%2F", "/"), ("%3A", ":"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def description_map(text: Column) -> Column:
    """map of the xKEY=VALUE lines of a description; of repeated keys the first holds."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: x.rlike(r"^[a-z][A-Z0-9]+="))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^[a-z]([A-Z0-9]+)=", 1).alias("key"), F.regexp_extract(x, r"=(.*)$", 1).alias("value")))
    first = F.filter(pairs, lambda p, k: ~F.exists(F.slice(pairs, F.lit(1), k), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(first)


@F.arrow_udf(T.StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Unicode normal form C; there is no built-in for it (Arrow's own leaves marks apart). A few texts at a time are Python's."""
    few = (text.slice(k, 256).to_pylist() for k in range(0, len(text), 256))
    return pa.chunked_array([pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in ts], pa.string()) for ts in few], pa.string()).combine_chunks()


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching blocks, as difflib finds them; there is no built-in for it."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])
