"""Text and time functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that comparisons ignore.
IGNORED = "\0\t\n\v\f\r !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¤°·¿—‘’“”•‥…※←↑→↓↔■◆◊○●\u3000、。〇〈〉《》「」『』【】〓〔〕〖〗〘〙〚〛〽゠・！＂＃＄％＆＇（）＊＋，－．／：；＜＝＞？＠［＼］＾＿｀｛｜｝～｟｠｡｢｣､･ｰﾟ￠￡￢￣￤￥￨￩￪￫￬￭￮"


def strip_ignored(text: Column) -> Column:
    """A string without its ignored characters."""
    return F.translate(text, IGNORED, "")


def significant_length(text: Column) -> Column:
    """Number of code points that aren't ignored."""
    return F.length(strip_ignored(text))


def drop_blank_lines(texts: Column) -> Column:
    """Lines with at least one significant character, unchanged."""
    return F.filter(texts, lambda t: significant_length(t) > 0)


def filtered_lines(texts: Column) -> Column:
    """Lines without ignored characters; emptied ones go."""
    return F.filter(F.transform(texts, strip_ignored), lambda t: t != "")


def edit_ratio(a: Column, b: Column) -> Column:
    """(n1 + n2 - distance) / (n1 + n2) in single precision; NaN of two empty strings."""
    total = (F.length(a) + F.length(b)).cast("float")
    ratio = ((total - F.levenshtein(a, b).cast("float")).cast("float") / F.when(total > 0, total)).cast("float")
    return F.coalesce(ratio, F.when(a.isNotNull() & b.isNotNull(), F.lit(float("nan")).cast("float")))


def match_cost(similarity: Column, scale: float = 1000.0) -> Column:
    """Integer cost of a similarity, truncated in single precision."""
    return (((F.lit(1.0).cast("float") - similarity.cast("float")).cast("float")) * F.lit(scale).cast("float")).cast("float").cast("int")


def time_string(ms: Column) -> Column:
    """HH:MM:SS.mmm; hours have as many digits as they need."""
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, ms % 1000)


def frame_ms(frame: Column, fps: Column | float) -> Column:
    """Milliseconds of a frame number, truncated."""
    return ((frame.cast("double") / fps) * F.lit(1000.0)).cast("long")


def code_points(text: Column) -> Column:
    """The numbers of a string's characters."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)


def to_utf32(text: Column) -> Column:
    """Four bytes for each character, highest first."""
    return F.encode(text, "UTF-32")


def from_utf32(data: Column) -> Column:
    return F.decode(data, "UTF-32")


def utf16(text: Column) -> Column:
    """Two bytes for each code unit, lowest first, without a mark."""
    return F.encode(text, "UTF-16LE")


def of_utf16(data: Column) -> Column:
    return F.decode(data, "UTF-16LE")


def common_prefix(least: Column, greatest: Column) -> Column:
    """The longest common start of two strings; of a group's least and greatest it
    is that of all."""
    n = F.least(F.length(least), F.length(greatest))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    differ = F.filter(places, lambda i: F.substring(least, i, F.lit(1)) != F.substring(greatest, i, F.lit(1)))
    return F.substring(least, F.lit(1), F.coalesce(F.get(differ, F.lit(0)) - 1, n))


def joined_name(least: Column, greatest: Column, extension: Column) -> Column:
    """Name of the file that joins some: their common start, else "output"."""
    start = F.regexp_replace(common_prefix(least, greatest), "[\\s_.-]+$", "")
    return F.concat(F.when(start != "", start).otherwise("output"), F.lit("."), extension)


def first_ignored(text: Column) -> Column:
    """Place from 0 of the first ignored character; null if there is none."""
    cut = F.substring_index(F.translate(text, IGNORED, " " * len(IGNORED)), " ", 1)
    return F.when(F.length(cut) < F.length(text), F.length(cut))
