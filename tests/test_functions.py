import datetime

import pytest
from pyspark.sql import functions as F

from tarnlake.functions import dates, scores, text, urls
from tarnlake.operators import evidence


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column).first()[0]


@pytest.mark.parametrize("name,key", [("The University of Oxford", "oxford"), ("ETH Zürich (Swiss Federal Institute)", "eth zurich"), ("Texas A&M University", "texas a and m"), ("Tsinghua - China", "tsinghua"), ("", "")])
def test_name_key(spark, name, key):
    assert one(spark, text.name_key(text.fold_ascii(text.html_unescape(F.col("x")))), x=name) == key


def test_slug_keeps_letters(spark):
    assert one(spark, text.slug(F.col("x")), x="Universität zu Köln!") == "u_universität_zu_köln"
    assert one(spark, text.short_slug(F.col("x")), x="--") == "prog"


def test_country_material_titles(spark):
    assert one(spark, text.country(F.col("x")), x=" China  (Mainland) ") == "China"
    assert one(spark, text.region(F.col("x")), x="Norway") == "Northern Europe"
    assert one(spark, text.material(F.col("x"), F.lit(False)), x="GRE") is None
    assert one(spark, text.material(F.col("x"), F.lit(True)), x="gre") == "GRE"
    assert one(spark, text.material(F.col("x"), F.lit(False)), x="Letter of  Motivation") == "Motivation letter"
    assert one(spark, text.programme_title(F.col("x")), x="Admission to the Master's programme in Physics") == "Physics"
    assert one(spark, text.repair_mojibake(F.col("x")), x="UniversitÃ¤t") == "Universität"
    assert one(spark, text.first_int(F.col("x")), x="=601-800") == 601


def test_urls(spark):
    u = "HTTPS://WWW.Example.org:443/A/b/?utm_source=x&id=3&ref=y#top"
    assert one(spark, urls.url_key(F.col("x")), x=u) == "https://www.example.org:443/A/b?id=3"
    assert one(spark, urls.queue_url(F.col("x")), x=u) == "https://www.example.org/A/b/?id=3"
    assert one(spark, urls.host(F.col("x")), x=u) == "example.org"
    assert one(spark, urls.url_key(F.col("x")), x="mailto:a") == ""
    assert one(spark, urls.registrable(F.lit("a.b.ac.uk"))) == "b.ac.uk"
    assert one(spark, urls.registrable(F.lit("a.b.example.org"))) == "example.org"
    assert one(spark, urls.denied(F.lit("https://en.wikipedia.org/x"))) is True
    assert one(spark, urls.denied(F.lit("https://notwikipedia.org/x"))) is False
    assert one(spark, urls.fingerprint(F.lit("http://www.a.org/P/"))) == one(spark, urls.fingerprint(F.lit("https://a.org/p")))


@pytest.mark.parametrize("said,day", [("2026-06-09", (2026, 6, 9)), ("2026-06", (2026, 6, 1)), ("until 9 June 2026", (2026, 6, 9)), ("June 9, 2026", (2026, 6, 9)), ("2026-02-31", None), ("soon", None), (None, None)])
def test_dates(spark, said, day):
    assert one(spark, dates.parse_date(F.col("x")), x=said) == (day and datetime.date(*day))


def test_deadlines(spark):
    df = spark.createDataFrame([([("Non-EU round", "2026-06-01", None), ("EU", "1 May 2026", None), ("", "2026-07", "All"), ("EU", "2026-05-01", None), ("old", "2020-01-01", None), ("x", "never", None)],)], "d array<struct<round:string,date:string,applicantGroup:string>>")
    got = df.select(dates.deadlines(F.col("d"), F.lit("2026-01-01").cast("date"))).first()[0]
    assert [(r["round"], str(r["date"]), r["applicantGroup"]) for r in got] == [("EU", "2026-05-01", "EU"), ("Non-EU round", "2026-06-01", "Non-EU"), ("Application", "2026-07-01", "All")]


@pytest.mark.parametrize("said,want", [("12", (12, 12, "exact")), ("=12", (12, 12, "exact")), ("601–800", (601, 800, "range")), ("601+", (601, None, "openEnded")), ("9-3", None), ("0", None), ("x", None)])
def test_ranks(spark, said, want):
    got = one(spark, scores.rank_range(F.col("x")), x=said)
    assert (got and tuple(got)) == want


def test_scores(spark):
    assert one(spark, scores.score(F.col("x")), x="101") is None
    assert one(spark, scores.score(F.col("x")), x=" 88.5") == 88.5
    assert one(spark, scores.sequence_ratio(F.lit("abcd"), F.lit("bcde"))) == 0.75
    assert one(spark, scores.completeness(F.lit(6), F.lit(6), F.lit(3), F.lit(0))) == 72


def test_evidence(spark):
    found = {k: one(spark, c) for k, c in evidence.signals(F.lit("The application deadline and IELTS score")).items()}
    assert found == {"requirements": False, "applicationWindow": True, "deadline": True, "documents": False, "language": True}
    assert one(spark, evidence.weighted(F.lit("MSc Computer Science and Robotics"))) == 24
    assert one(spark, evidence.captcha(F.lit("<div class='g-recaptcha'>"))) is True
    assert one(spark, evidence.captcha(F.lit("g-recaptcha size=invisible"))) is False
    assert one(spark, evidence.platform(F.lit("server: cloudflare"))) == "cloudflare"
