"""Columns over paths, sizes and durations: all built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by kind of file.
TEXT_EXTENSIONS = frozenset(
    ".txt .md .py .js .html .htm .css .xml .json .csv .log .conf .cfg .ini .yml .yaml .sql .java .cpp .c .h .hpp .cs .php .rb .go "
    ".rs .swift .kt .scala .pl .sh .bat .ps1 .tex .rtf .rst .wiki .adoc .asciidoc".split()
)
IMAGE_EXTENSIONS = frozenset(".jpg .jpeg .png .bmp .gif .tiff .tif .webp .svg .heic .heif .jp2 .j2k .dng".split())
VIDEO_EXTENSIONS = frozenset(".mp4 .avi .mkv .mov .wmv .flv .webm .m4v .3gp .asf .rm .rmvb".split())
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")
# The units of elapsed time as displayed.
HOUR, MINUTE, SECOND = "时", "分", "秒"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The lower-case extension with its dot; '' for none and for names that only start with a dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+?(\.[^.]+)$", 1))


def stem(name: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def has_extension(path: Column, extensions) -> Column:
    return suffix(path).isin(sorted(extensions))


def one_decimal(value: Column) -> Column:
    """One decimal, the nearest to the value held; ties go to the even digit, which Java's %.1f rounds up."""
    return F.call_function("format_number", value, F.lit("0.0"))


def format_size(size: Column, units: tuple[str, ...] = SIZE_UNITS) -> Column:
    """One decimal and a unit in steps of 1024; the last unit takes the rest."""
    value = size.cast("double")
    shown = lambda power: F.concat(one_decimal(value / float(1024**power)), F.lit(" " + units[power]))
    out = shown(len(units) - 1)
    for power in range(len(units) - 2, -1, -1):
        out = F.when(value < float(1024 ** (power + 1)), shown(power)).otherwise(out)
    return out


def parse_size(text: Column) -> Column:
    """Bytes of "v UNIT"; an unknown unit counts as bytes, anything else as 0."""
    parts = F.split(F.trim(text), r"\s+")
    unit = F.upper(F.get(parts, F.lit(1)))
    scale = F.lit(1.0)
    for power, name in enumerate(SIZE_UNITS[1:5], 1):
        scale = F.when(unit == name, F.lit(float(1024**power))).otherwise(scale)
    return F.coalesce(F.when(F.size(parts) == 2, F.get(parts, F.lit(0)).try_cast("double") * scale), F.lit(0.0))


def format_duration(seconds: Column) -> Column:
    whole = F.floor(F.coalesce(seconds, F.lit(0.0)).cast("double"))
    h, m, s = F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60))
    return F.when(F.coalesce(seconds, F.lit(0.0)) <= 0, F.lit("N/A")).when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def format_elapsed(seconds: Column) -> Column:
    """Elapsed time in the units HOUR, MINUTE and SECOND, leading zeros left out."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    text = lambda c, u: F.concat(c.cast("string"), F.lit(u))
    return F.when(s < 60, text(s, SECOND)).when(s < 3600, F.concat(text(m, MINUTE), text(r, SECOND))).otherwise(F.concat(text(h, HOUR), text(m, MINUTE), text(r, SECOND)))


def parse_number(text: Column) -> Column:
    return F.coalesce(text.try_cast("long"), F.lit(0))


def resolution_score(text: Column) -> Column:
    """width * height of "WxH", else 0."""
    parts = F.split(text, "x")
    return F.coalesce(F.when(F.size(parts) == 2, F.get(parts, F.lit(0)).try_cast("long") * F.get(parts, F.lit(1)).try_cast("long")), F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    """The smaller over the larger; null where the larger is 0."""
    return F.least(a, b) / F.nullif(F.greatest(a, b), F.lit(0))


def hash_threshold(percent: Column) -> Column:
    """Differing bits of 64 that a similarity in percent allows."""
    return F.greatest(F.lit(0), F.least(F.lit(64), (64 * (1 - percent / F.lit(100.0))).cast("int")))


def frame_indices(total: Column, n: int, skip_ends: bool = True) -> Column:
    """Indices of the frames to sample: all of a short video, else n evenly spaced, truncated.

    skip_ends leaves out a tenth at either end; otherwise the range is the whole video.
    """
    whole = F.when(total > 0, F.sequence(F.lit(0).cast("long"), total - 1))
    first = F.floor(total * F.lit(0.1)).cast("double") if skip_ends else F.lit(0.0)
    last = F.floor(total * F.lit(0.9)).cast("double") if skip_ends else (total - 1).cast("double")
    step = (last - first) / F.lit(float(max(1, n - 1)))
    spaced = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(first + i * step))
    return F.when(total <= 0, F.lit(None)).when(total <= n, whole).otherwise(spaced) if skip_ends else F.when(total > 0, spaced)


def video_metadata(size: Column, fps: Column, frames: Column, estimate: bool = True) -> tuple[Column, Column]:
    """(frame_count, duration): estimated from the size at 2 MB a second where the container says nothing."""
    mb = size / F.lit(1048576.0)
    if not estimate:
        return frames, F.when(fps > 0, frames / fps).otherwise(F.lit(0.0))
    count = F.when((frames <= 0) & (fps > 0), F.floor(mb / 2 * fps)).otherwise(frames).cast("long")
    return count, F.when(fps > 0, count / fps).otherwise(F.greatest(F.lit(1.0), mb / 2))


def between(value: Column, least=0, most=None) -> Column:
    """Inclusive range filter in which a missing value counts as 0."""
    v = F.coalesce(value, F.lit(0))
    return (v >= least) if most is None else (v >= least) & (v <= most)
