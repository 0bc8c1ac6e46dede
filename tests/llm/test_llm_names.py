"""Every operator that gives a caller's columns back, on columns named like its own inside."""

import re
from pathlib import Path

import pytest

from tracelume.llm import decontaminate, jaccard, line_dedup, mixing, names, quality_rules, scratch, simhash

CODE = "".join(p.read_text() for p in Path(names.__file__).parent.glob("*.py"))
#: All names of columns that the operators' code has, and what else a caller may think of.
INSIDE = sorted({x.lower() for x in re.findall(r'"([A-Za-z_]\w{0,14})"', CODE)} - {"doc_id", "text", "lang", "source", "url", "lines", "item_id", "domain"})
TEXTS = ["a b c d e f g h " * 4 + f"w{k} x{k} y{k}" for k in range(12)] + [None, ""]
OPERATORS = {
    "simhash.keep_one": lambda d, s: simhash.keep_one(d),
    "jaccard.keep_one": lambda d, s: jaccard.keep_one(d),
    "decontaminate": lambda d, s: decontaminate.decontaminate(d, s.createDataFrame([(1, "w3 x3 y3")], "item_id long, text string")),
    "decontaminate, joined": lambda d, s: decontaminate.decontaminate(d, s.createDataFrame([(1, "w3 x3 y3")], "item_id long, text string"), broadcast_bytes=0),
    "quality": lambda d, s: quality_rules.judged(d),
    "statistics": lambda d, s: quality_rules.with_statistics(d),
    "mixing": lambda d, s: mixing.mixed(d, s.createDataFrame([(1, "a"), (2, "b")], "doc_id long, domain string"), {"a": 1.0})[0],
    "site lines": lambda d, s: line_dedup.drop_site_lines(d, "lang", "lines"),
}
ADDED = ("mix_tokens", "mix_posteriors", "mix_rate", "mix_copies", "kept_lines")


@pytest.fixture(scope="module")
def docs(spark):
    inside = [c for c in INSIDE if c not in ADDED and not c.startswith("q_")]
    assert len(inside) > 150
    schema = "doc_id long, text string, lang string, source string, n_chars_ long, lines array<string>, in_0 long, in_3 long, " + ", ".join(f"`{c}` string" for c in inside)
    rows = [(k, t, "en", "s", 1, ["l"], 7, 8, *inside) for k, t in enumerate(TEXTS)]
    return scratch.Scratch(spark).table(spark.createDataFrame(rows, schema), "wide")


@pytest.mark.parametrize("name", OPERATORS)
def test_names_of_columns_do_not_matter(spark, docs, name):
    out = OPERATORS[name](docs, spark)
    added = [c for c in out.columns if c not in docs.columns]
    assert out.columns == [*docs.columns, *added]
    rows = out.collect()
    assert rows and all(r[c] == c for r in rows for c in docs.columns[8:])
    assert all(r.text == TEXTS[r.doc_id] and (r.in_0, r.in_3) == (7, 8) for r in rows)


def test_results_replace_columns_of_their_names(spark, docs):
    some = docs.select("doc_id", "text", "lang", "source", *[docs.text.alias(c) for c in ("q_kept", "q_n_words", "mix_rate")])
    out = quality_rules.judged(some)
    assert out.columns.count("q_kept") == 1 and dict(out.dtypes)["q_kept"] == "boolean" and "mix_rate" in out.columns
    out = OPERATORS["mixing"](some, spark)
    assert dict(out.dtypes)["mix_rate"] == "double" and dict(out.dtypes)["q_kept"] == "string"


def test_shared_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app-1"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        scratch.shared_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://x/shared/"}
    assert scratch.shared_dir(Session()) == "hdfs://x/shared/tracelume-app-1"
    with scratch.recorded() as made:
        path = scratch.new_path(spark, "x")
    scratch.new_path(spark, "y")
    assert made == [path]
