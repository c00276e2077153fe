"""The catalog of installed font families, from file names alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalize_key

#: Normalised family name -> display name, category, whether it covers Greek.
KNOWN = {
    "cardo": ("Cardo", "serif", True),
    "ebgaramond": ("EB Garamond", "serif", True),
    "gentiumbookplus": ("Gentium Book Plus", "serif", True),
    "gentiumplus": ("Gentium Plus", "serif", True),
    "oldstandardtt": ("Old Standard", "serif", True),
    "oldstandard": ("Old Standard", "serif", True),
    "librebaskerville": ("Libre Baskerville", "serif", False),
    "imfellenglish": ("IM Fell English", "serif", False),
    "imfelldwpica": ("IM Fell DW Pica", "serif", False),
    "notoserif": ("Noto Serif", "serif", True),
    "junicode": ("Junicode", "medieval", True),
    "unifrakturmaguntia": ("UnifrakturMaguntia", "medieval", False),
    "unifrakturcook": ("UnifrakturCook", "medieval", False),
    "medievalsharp": ("MedievalSharp", "medieval", False),
    "grenzegotisch": ("Grenze Gotisch", "medieval", False),
    "pirataone": ("Pirata One", "medieval", False),
    "uncialantiqua": ("Uncial Antiqua", "medieval", False),
    "gfsdidot": ("GFS Didot", "greek", True),
    "gfsneohellenic": ("GFS Neohellenic", "greek", True),
    "gfsporson": ("GFS Porson", "greek", True),
}
CATEGORY_RANK = {"serif": 0, "medieval": 1, "greek": 2, "other": 3}
STYLE_WORDS = ("bolditalic", "boldoblique", "semibolditalic", "extrabold", "semibold", "italic", "oblique", "bold", "medium", "light", "regular", "roman", "book", "display")
STYLES = ("regular", "italic", "bold", "bolditalic")

_TRIM = r"^[-_ ]+|[-_ ]+$"


def strip_style(name: Column) -> Column:
    """The family part of a file's stem: trailing style words off, but never the whole name."""
    s = F.regexp_replace(name, _TRIM, "")
    return F.regexp_replace(F.regexp_replace(s, rf"(?i)(?<=.)(?:[-_ ]*(?:{'|'.join(STYLE_WORDS)}))+$", ""), _TRIM, "")


def parsed(files: DataFrame) -> DataFrame:
    """path, ext_rank, key, display, style from a table of paths."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = files.select("path", F.regexp_extract(F.lower(name), r"\.(ttf|otf)$", 1).alias("ext"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem")).where("ext <> ''")
    cleaned = F.regexp_replace("stem", r"\[.*?\]", "")
    low = F.lower(F.regexp_replace(cleaned, "[-_ ]", ""))
    bold, italic = low.contains("bold"), low.contains("italic") | low.contains("oblique")
    style = F.when(bold & italic, "bolditalic").when(bold, "bold").when(italic, "italic").otherwise("regular")
    family = F.coalesce(F.nullif(strip_style(cleaned), F.lit("")), cleaned)
    display = F.trim(F.regexp_replace(family, "[-_]+", " "))
    return rows.select("path", (F.col("ext") == "otf").cast("int").alias("ext_rank"), normalize_key(family).alias("key"), display.alias("display"), style.alias("style")).where("key <> ''")


def families(files: DataFrame) -> DataFrame:
    """One row a family: key, display, category, greek, files (style -> path), regular, italic, bold.

    Files count in the order ttf before otf, then by path; the first of a style stands, and the first of a
    family names it where it is not a known one."""
    rows = parsed(files)
    place = F.struct("ext_rank", "path")
    first = F.row_number().over(Window.partitionBy("key", "style").orderBy("ext_rank", "path"))
    kept = rows.withColumn("n", first)
    grouped = kept.groupBy("key").agg(
        F.min_by("display", place).alias("shown"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("n") == 1, F.struct("style", "path"))))).alias("files"),
        F.min_by("path", place).alias("any"),
    )
    entries = [F.struct(F.lit(d).alias("display"), F.lit(c).alias("category"), F.lit(g).alias("greek")) for d, c, g in KNOWN.values()]
    known = F.map_from_arrays(F.array(*[F.lit(k) for k in KNOWN]), F.array(*entries))
    found = grouped.withColumn("m", F.try_element_at(known, F.col("key")))
    file = lambda s: F.try_element_at("files", F.lit(s))
    return found.select(
        "key",
        F.coalesce("m.display", "shown").alias("display"),
        F.coalesce("m.category", F.lit("other")).alias("category"),
        F.col("m.greek").alias("greek"),
        "files",
        F.coalesce(file("regular"), file("bold"), file("italic"), F.col("any")).alias("regular"),
        F.coalesce(file("italic"), file("bolditalic")).alias("italic"),
        F.coalesce(file("bold"), file("bolditalic")).alias("bold"),
    )


def catalog(files: DataFrame) -> DataFrame:
    """rank, id, label, category, greek, has_italic, has_bold, in catalog order."""
    rank = F.lit(9)
    for name, r in CATEGORY_RANK.items():
        rank = F.when(F.col("category") == name, r).otherwise(rank)
    rows = families(files)
    place = F.row_number().over(Window.orderBy(rank, F.lower("display"), "key"))  # a few hundred families
    return rows.select(place.alias("rank"), F.col("key").alias("id"), F.col("display").alias("label"), "category", "greek", F.col("italic").isNotNull().alias("has_italic"), F.col("bold").isNotNull().alias("has_bold"))


def by_category(files: DataFrame) -> DataFrame:
    return catalog(files).groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("labels"))


def resolve(requested: Column, known: DataFrame) -> Column:
    """The path that a family name comes to in a map column built from `families`; Times-Roman where none."""
    paths = F.map_from_entries(F.collect_list(F.struct("key", "regular")))
    table = known.agg(paths.alias("m")).first()
    held = (table.m if table else None) or {}
    chosen = F.lit(None).cast("string")
    for key, path in held.items():
        chosen = F.when(normalize_key(requested) == key, path).otherwise(chosen)
    fallback = next(iter(held.values()), "Times-Roman")
    return F.coalesce(chosen, F.lit(fallback))
