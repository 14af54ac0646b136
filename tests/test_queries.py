import html
import re
import unicodedata

import pytest

from tarnlake.functions import rules
from tarnlake.plans import catalog
from tests.conftest import SF
from tests.oracle import duck, rows


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLES:
        assert rows(got) == rows(duck(SF, catalog.ORACLES[name]))
    else:
        assert len(got) > 0


def test_name_keys_of_whole_texts(spark, tmp_path):
    texts = ["St. Gallen. Universit\u00e9 de Gen\u00e8ve &amp; Inst. (X) of Z\u00fcrich. The End", "the Univ. of A.B. -- C&D", "", None, "Plain name"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def keys(t):
        if t is None:
            return (None,) * 4
        nfkd = lambda v: unicodedata.normalize("NFKD", v)
        low = nfkd(html.unescape(t)).encode("ascii", "ignore").decode().lower()
        name = re.sub(r"\s*\([^)]*\)\s*", " ", low.replace("&", " and ").replace("--", " "))
        name = re.sub(r"[^\w\s]", " ", re.sub(r"\s+-\s+(?:china|mainland china)$", " ", name))
        name = " ".join(w for w in name.split() if w not in rules.NAME_STOP_WORDS)
        alias = re.sub(r"\buniv\.", "university", re.sub(r"\binst\.", "institute", low))
        alias = re.sub("^the ", "", re.sub("[^a-z0-9]+", " ", alias).strip())
        plain = "".join(c for c in nfkd(t) if not unicodedata.combining(c)).lower().replace("&", " and ")
        return name, alias, " ".join(re.findall("[a-z0-9]+", plain)), "".join(c for c in plain if c.isalnum())

    got = catalog.QUERIES["name_keys"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["name_key"], r["alias_key"], r["token_key"], r["compact_key"]) for r in got} == {i: keys(t) for i, t in enumerate(texts)}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
