"""What pages are served from: programmes by institution, rankings with filters, indexes, boards and status lists.

Tables: universities (id, name, country, region), aliases (id, canonical_id), programs (id, university_id, program, subject, verified,
deadlines, requirements, source_url), rankings (source, university_id, name, country, rank), coverage (id, status, urls).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions import text
from tarnlake.operators import dedup


def canonical(df: DataFrame, column: str, aliases: DataFrame, name: str = "canonical_id") -> DataFrame:
    """The id that an id stands for, itself where there is no alias: one hop."""
    one = aliases.groupBy(F.col("id").alias("_a")).agg(F.min("canonical_id").alias("_c"))
    return df.join(one, df[column] == one["_a"], "left").withColumn(name, F.coalesce("_c", column)).drop("_a", "_c")


def programmes_by_university(programs: DataFrame, universities: DataFrame, aliases: DataFrame) -> DataFrame:
    """programs, once for every id that stands for the same institution, in for_id; of programmes with one url and name the first counts."""
    mine = canonical(programs, "university_id", aliases)
    once = dedup.keep_best(mine.withColumn("_k", text.site_key(F.col("program"))), ["canonical_id", "source_url", "_k"], [F.col("id")]).drop("_k")
    ids = canonical(universities.select("id"), "id", aliases).select(F.col("id").alias("for_id"), "canonical_id")
    return ids.join(once, "canonical_id")


def by_id_or_name(df: DataFrame, id_column: str, name_key: str, table: DataFrame, table_id: str, table_key: str, values: list[str]) -> DataFrame:
    """values of the table's row with the id, else of one with the name key (the smallest id of several)."""
    first = lambda key: table.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*values), F.col(table_id)).alias("_v"))
    by_id, by_name = first(table_id).withColumnsRenamed({"_k": "_i", "_v": "_x"}), first(table_key).withColumnsRenamed({"_k": "_n", "_v": "_y"})
    both = df.join(by_id, df[id_column] == by_id["_i"], "left").join(by_name, df[name_key] == by_name["_n"], "left")
    return both.withColumn("_z", F.coalesce("_x", "_y")).select(*df.columns, *(F.col("_z")[v].alias(v) for v in values))


def programme_stats(programs: DataFrame, key: str, has_requirement: Column) -> DataFrame:
    """Per key: programmes, verified ones, deadlines (lengths of lists added up), ones with requirements."""
    return programs.groupBy(key).agg(F.count("*").alias("total"), F.count_if("verified").alias("verified"), F.sum(F.size("deadlines")).alias("deadlines"), F.count_if(has_requirement).alias("requirements"))


def ranking_page(rows: DataFrame, region: str | None = None, text_: str | None = None, europe: bool = False, programmes: bool = False, requirements: bool = False, coverage: str | None = None, limit: int | None = 100, offset: int = 0) -> DataFrame:
    """One page of a ranking, in order of rank and name: rows with the filters that are set.

    rows: rank, name, country, region, is_europe, programmes, requirements, coverage, urls.
    """
    out = rows
    if europe:
        out = out.where("is_europe")
    if programmes:
        out = out.where("programmes > 0")
    if requirements:
        out = out.where("requirements > 0")
    if coverage == "covered":
        out = out.where("coverage = 'covered' AND urls > 0")
    elif coverage == "missing":
        out = out.where("coverage = 'missing'")
    if region:
        out = out.where(F.col("region") == region)
    if text_:
        needle = F.lit(text_)
        out = out.where(F.contains(text.fold_search(F.col("name")), needle) | F.contains(text.fold_search(F.col("country")), needle))
    out = out.orderBy("rank", "name")
    return out.offset(offset).limit(limit) if limit else out.offset(offset)


def programme_order(requirement: Column, deadlines: Column, university: Column, program: Column) -> list[Column]:
    """Verified ones first, then ones with requirements, with most deadlines, by institution and name (by letters, not by code points)."""
    by_letters = lambda c: F.collate(c, "UNICODE")
    return [F.col("verified").desc(), requirement.desc(), deadlines.desc(), by_letters(university), by_letters(program)]


# The order of capture statuses in lists.
STATUS_ORDER = ("captured", "checked-no-program", "needs-review", "blocked", "pending")


def data_status(schools: DataFrame, status: str | None = None, country: str | None = None, hide_mainland: bool = True, text_: str = "", limit: int = 80) -> DataFrame:
    """The list of institutions by capture status and name, filtered. schools: name, country, status, mainland."""
    out = schools
    if status:
        out = out.where(F.col("status") == status)
    if hide_mainland:
        out = out.where("NOT mainland")
    if country:
        out = out.where(F.col("country") == country)
    if text_.strip():
        out = out.where(F.contains(F.lower(F.concat_ws(" ", "name", "country")), F.lit(text_.strip().lower())))
    return out.orderBy(F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("status")), "name").limit(limit)


def university_index(universities: DataFrame, rankings: DataFrame, aliases: DataFrame, boards: list[str]) -> DataFrame:
    """(id, name, ranks): the ranks of every id on each board, entries with one name key sharing theirs, and ids of one institution one per board.

    Of several ranks of an institution on a board the one of its smallest id counts. ranks: array<struct<source,rank>> in order of the boards.
    """
    known = universities.select("id", "name").union(rankings.select("university_id", "name")).withColumn("k", text.site_key(F.col("name")))
    ids = canonical(known.groupBy("id").agg(F.min("name").alias("name"), F.min("k").alias("k")), "id", aliases)
    keyed = rankings.withColumn("k", text.site_key(F.col("name"))).select("k", "source", "rank", "university_id")
    place = F.array_position(F.array(*map(F.lit, boards)), F.col("source"))
    each = ids.select("id", "canonical_id", "k").join(keyed, "k")
    first = each.groupBy("canonical_id", "source").agg(F.min_by("rank", F.struct("id", "university_id", "rank")).alias("rank"))
    listed = first.groupBy("canonical_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), "source", "rank"))).alias("r"))
    ranks = F.coalesce(F.transform("r", lambda x: F.struct(x["source"].alias("source"), x["rank"].alias("rank"))), F.array().cast("array<struct<source:string,rank:int>>"))
    return ids.join(listed, "canonical_id", "left").select("id", "name", ranks.alias("ranks"))


def drawer(university: str, universities: DataFrame, aliases: DataFrame, ranks: DataFrame, programs: DataFrame, coverage: DataFrame, boards: list[str], urls: int = 6) -> DataFrame:
    """One row for an institution: its canonical entry, a rank per board, its programmes in order, and the first urls of its coverage."""
    asked = canonical(universities.where(F.col("id") == university).select(F.col("id").alias("asked")), "asked", aliases)
    entry = asked.join(universities.withColumnRenamed("id", "canonical_id"), "canonical_id")
    pivoted = ranks.where(F.col("source").isin(*boards)).groupBy("university_id").pivot("source", boards).agg(F.min("rank"))
    listed = programmes_by_university(programs, universities, aliases).where(F.col("for_id") == university)
    ordered = listed.groupBy("for_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((~F.col("verified")).alias("a"), "program", "id"))), lambda p: p["id"]).alias("programs"))
    cover = coverage.select(F.col("id").alias("_c"), F.slice("urls", 1, urls).alias("urls"))
    out = entry.join(pivoted, F.col("canonical_id") == F.col("university_id"), "left").drop("university_id")
    return out.join(ordered, F.col("asked") == F.col("for_id"), "left").drop("for_id").join(cover, F.col("canonical_id") == F.col("_c"), "left").drop("_c")


def programmes_named(programs: DataFrame, universities: DataFrame, name: str) -> DataFrame:
    """Programmes of the institution of that name (by name key); an id without an entry is read as its name."""
    u = universities.groupBy(F.col("id").alias("_u")).agg(F.min("name").alias("_n"))
    said = F.coalesce("_n", F.replace(F.regexp_replace("university_id", "^u_", ""), F.lit("_"), F.lit(" ")))
    asked = F.element_at(F.transform(F.array(F.lit(name)), lambda n: text.site_key(n)), 1)
    return programs.join(u, F.col("university_id") == F.col("_u"), "left").where(text.site_key(said) == asked).drop("_u", "_n")


def apply_overrides(records: DataFrame, by_university: DataFrame, by_url: DataFrame) -> DataFrame:
    """records with what reviewers said: first for the institution, then for the programme's url; later ones win, materials are added.

    Overrides: key, deadlines (array, null: keep), requirements (map), materials (array). records: id, university_id, source_url, deadlines, requirements (map), materials.
    """

    def once(df: DataFrame, key: Column, overrides: DataFrame) -> DataFrame:
        o = overrides.select(F.col("key").alias("_k"), *(F.col(c).alias(f"_{c}") for c in ("deadlines", "requirements", "materials")))
        both = df.join(o, key == F.col("_k"), "left")
        said = F.map_filter(F.coalesce("_requirements", F.create_map().cast("map<string,string>")), lambda k, v: v != "")
        kept = F.map_filter("requirements", lambda k, v: ~F.map_contains_key(said, k))
        changes = {"deadlines": F.coalesce("_deadlines", "deadlines"), "requirements": F.map_concat(kept, said), "materials": text.merge_unique(F.col("materials"), F.col("_materials"))}
        return both.withColumns(changes).select(*df.columns)

    url = F.lower(F.regexp_replace(F.regexp_replace("source_url", "#.*$", ""), "/+$", ""))
    return once(once(records, F.col("university_id"), by_university), url, by_url)
