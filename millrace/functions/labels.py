"""Label, name and text functions on columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Free text to family and subtype, the first row whose words are all found wins.
TEXT_RULES = (
    (("crack", "alligator"), "crack", "network_alligator"),
    (("crack", "network"), "crack", "network_alligator"),
    (("crack", "deposit"), "crack", "with_deposit"),
    (("crack", "precipitation"), "crack", "with_deposit"),
    (("crack",), "crack", "unspecified"),
    (("spall",), "spalling", "not_applicable"),
    (("honeycomb",), "honeycombing_rock_pocket", "not_applicable"),
    (("rock pocket",), "honeycombing_rock_pocket", "not_applicable"),
    (("rockpocket",), "honeycombing_rock_pocket", "not_applicable"),
    (("exposed rebar",), "exposed_rebar", "not_applicable"),
    (("exposed reinforcement",), "exposed_rebar", "not_applicable"),
    (("rust",), "rust_staining", "not_applicable"),
    (("corrosion stain",), "rust_staining", "not_applicable"),
    (("efflorescence",), "efflorescence_leaching", "not_applicable"),
    (("leaching",), "efflorescence_leaching", "not_applicable"),
)
# Model labels to family and subtype.
MODEL_LABELS = {
    "crack": ("crack", "unspecified"),
    "spalling": ("spalling", "not_applicable"),
    "honeycombing_rock_pocket": ("honeycombing_rock_pocket", "not_applicable"),
    "exposed_rebar": ("exposed_rebar", "not_applicable"),
    "rust_staining": ("rust_staining", "not_applicable"),
    "efflorescence_leaching": ("efflorescence_leaching", "not_applicable"),
}
# Native labels to canonical label and strength of the mapping.
NATIVE_LABELS = {
    "crack": ("crack", "direct"),
    "Crack": ("crack", "direct"),
    "ACrack": ("crack", "direct"),
    "Spalling": ("spalling", "direct"),
    "spalling": ("spalling", "direct"),
    "Rockpocket": ("honeycombing_rock_pocket", "strong"),
    "Cavity": ("unknown_review", "unknown"),
    "Hollowareas": ("unknown_review", "unknown"),
    "Wetspot": ("unknown_review", "unknown"),
    "Weathering": ("unknown_review", "unknown"),
    "WConccor": ("unknown_review", "unknown"),
    "ExposedRebars": ("exposed_rebar", "direct"),
    "Rust": ("rust_staining", "direct_visual"),
    "corrosion": ("rust_staining", "weak"),
    "Efflorescence": ("efflorescence_leaching", "direct"),
    "efflorescence": ("efflorescence_leaching", "direct"),
}


def pair_type(a: str, b: str) -> str:
    return f"struct<{a}:string,{b}:string>"


def canonical_text(label: Column, rules=TEXT_RULES) -> Column:
    """struct(family, subtype) of a free text by rules; null if none fits."""
    words = F.trim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", " "))
    out = F.lit(None).cast(pair_type("family", "subtype"))
    for needles, family, subtype in reversed(rules):
        fits = F.lit(True)
        for n in needles:
            fits = fits & words.contains(n)
        out = F.when(fits, F.struct(F.lit(family).alias("family"), F.lit(subtype).alias("subtype"))).otherwise(out)
    return out


def canonical_model_label(label: Column, table: Mapping[str, tuple[str, str]] = MODEL_LABELS) -> Column:
    """struct(family, subtype) of a model's label; spaces and dashes count as underscores."""
    return lookup(F.translate(F.lower(F.trim(label)), "- ", "__"), table, "family", "subtype")


def lookup(key: Column, table: Mapping[str, tuple[str, str]], a: str, b: str) -> Column:
    """The pair that a small fixed table has for key, as a struct; null where it has none."""
    out = F.lit(None).cast(pair_type(a, b))
    for k, (x, y) in table.items():
        out = F.when(key == k, F.struct(F.lit(x).alias(a), F.lit(y).alias(b))).otherwise(out)
    return out


def split_labels(packed: Column) -> Column:
    """Labels of a text that joins them by | or ; without blanks."""
    return F.filter(F.transform(F.split(F.translate(packed, "|", ";"), ";"), lambda x: F.trim(x)), lambda x: x != "")


def join_labels(labels: Column) -> Column:
    """Sorted distinct labels joined by |."""
    return F.array_join(F.array_sort(F.array_distinct(labels)), "|")


def label_vector(labels: Column, classes: list[str]) -> Column:
    return F.array(*[F.array_contains(labels, c).cast("int") for c in classes])


def human_bytes(n: Column) -> Column:
    """Bytes in the largest binary unit up to TiB that leaves 1 at least; bytes as they are below 1024."""
    out = F.format_string("%.2f TiB", n / float(1024**4))
    for unit, p in (("GiB", 3), ("MiB", 2), ("KiB", 1)):
        out = F.when(n < 1024 ** (p + 1), F.format_string(f"%.2f {unit}", n / float(1024**p))).otherwise(out)
    return F.when(n < 1024, F.format_string("%.2f B", n.cast("double"))).otherwise(out)


def parent_name(crop: Column) -> Column:
    """A crop's name without its number."""
    return F.regexp_replace(crop, r"_crop_[0-9]+$", "")


def stem(path: Column) -> Column:
    """A path's file name without its last extension, lower-cased."""
    return F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""))


def split_of_path(path: Column, choices: list[str]) -> Column:
    """The first of choices that is a segment of the path or begins its file name; else unknown."""
    name = F.element_at(F.split(path, "/"), -1)
    out = F.lit("unknown")
    for c in reversed(choices):
        out = F.when(F.array_contains(F.split(path, "/"), c) | name.startswith(c), c).otherwise(out)
    return out


def location_token(v: Column, extent: Column) -> Column:
    """A coordinate as one of 1001 places along its extent."""
    return F.concat(F.lit("<loc_"), F.greatest(F.lit(0), F.least(F.lit(1000), F.bround(v / extent * 1000, 0).cast("int"))).cast("string"), F.lit(">"))


def seeded_rank(key: Column, seed: str) -> Column:
    """A fixed random order of keys: the SHA-256 of seed:key."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def prefix_of(path: Column) -> Column:
    """A file name's part before the first underscore."""
    return F.split_part(stem(path), F.lit("_"), F.lit(1))


def has_ends(path: Column, prefix: str, suffix: str) -> Column:
    """Whether a path begins with prefix and ends with suffix, the suffix without regard to case."""
    return path.startswith(prefix) & F.lower(path).endswith(suffix.lower())


def path_fits(path: Column, root: str, splits: list[str], folders: list[str]) -> Column:
    """Whether a path is root/split/folder/name of known splits and folders."""
    p = F.split(path, "/")
    return (F.size(p) == 4) & (p[0] == root) & p[1].isin(*splits) & p[2].isin(*folders) & (p[3] != "")


def held_out_path(path: Column) -> Column:
    """Whether a folder of the path is named test, whatever its case and the slashes."""
    return F.lower(F.translate(path, "\\", "/")).contains("/test/")


def record_id(source: str, split: Column, path: Column) -> Column:
    return F.concat_ws("_", F.lit(source), split, stem(path))


def paired_name(mask: Column, mark: str = "_lab", ending: str = ".png") -> Column:
    """The image's name of a mask's: without its mark; null if it has none."""
    return F.when(mask.endswith(mark + ending), F.concat(F.substr(mask, F.lit(1), F.length(mask) - len(mark + ending)), F.lit(ending)))


def coerced(value: Column, known: list[str], default: str = "unknown") -> Column:
    return F.when(value.isin(*known), value).otherwise(default)


def canonical_set(native: Column, table=NATIVE_LABELS, unknown: str = "unknown_review") -> Column:
    """Sorted distinct canonical labels of an array of native ones; unknown ones are left out."""
    found = F.transform(native, lambda x: lookup(x, table, "label", "strength")["label"])
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull() & (x != unknown))))


def map_value(table: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(table, key), default)


def zip_shortest(**arrays: Column) -> Column:
    """Structs of the arrays' members by place, as many as the shortest has."""
    n = F.least(*[F.size(a) for a in arrays.values()]) if len(arrays) > 1 else F.size(next(iter(arrays.values())))
    return F.arrays_zip(*[F.slice(a, F.lit(1), n).alias(k) for k, a in arrays.items()])


def utc_text(time: Column) -> Column:
    """A time as ISO text in UTC to the second, with Z."""
    return F.date_format(F.convert_timezone(None, F.lit("UTC"), time.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def compact_json(value: Column) -> Column:
    """JSON without spaces; null fields are written."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def rounded(value: Column, digits: int) -> Column:
    """Rounded half to even on the number's shortest decimal text, as decimal arithmetic does."""
    return F.bround(value.cast("string").cast(f"decimal(38,{min(digits + 12, 18)})"), digits).cast("double")


def shard_split(source: Column) -> Column:
    """The split that a shard's file name begins with, as in train-00001-of-00009."""
    return F.regexp_extract(source, r"(?:^|/)([A-Za-z]+)[_-][^/]*$", 1)


def archive_report(output: Column, code: Column) -> Column:
    """struct(everything_ok, folders, files, size, compressed, diagnostic) of an archive tool's test report; numbers that it
    does not name are null, the diagnostic is the end of a report of failure."""
    number = lambda k: F.regexp_extract(output, rf"(?m)^{k}:\s+(\d+)\s*$", 1).try_cast("bigint")
    ok = (code == 0) & output.contains("Everything is Ok")
    return F.struct(ok.alias("everything_ok"), *[number(k).alias(k.lower()) for k in ("Folders", "Files", "Size", "Compressed")], F.when(~ok, F.right(output, F.lit(2000))).alias("diagnostic"))


def json_text(document: Column, field: str, default: str | None = None) -> Column:
    """A field of a JSON object as text; default where the object lacks it or is none."""
    return F.coalesce(F.get_json_object(document, f"$.{field}"), F.lit(default).cast("string"))


def broken_json(document: Column) -> Column:
    return F.try_parse_json(document).isNull()
