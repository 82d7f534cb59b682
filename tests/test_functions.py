"""Expressions on literal rows: each case pins a rule that is easy to get wrong."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from relloom.functions import arrays, hashing, metrics
from relloom.functions import text as tx


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_strip_takes_unicode_space(spark):
    assert one(spark, tx.strip("t"), t=" a　") == "a"


@pytest.mark.parametrize("text, label", [(" Yes, because", "yes"), ("maybe", None), ("NO.", "no"), ("", None)])
def test_first_token_label(spark, text, label):
    assert one(spark, tx.first_token_label("t"), t=text) == label


def test_tag_body_is_the_first_and_stripped(spark):
    assert one(spark, tx.tag_body("t", "a"), t="<a> x\ny </a><a>z</a>") == "x\ny"
    assert one(spark, tx.tag_body("t", "a"), t="<a>  </a>") is None


def test_judge_scores_are_all_or_nothing(spark):
    full = "<scores>" + "".join(f"<{f}>{i % 5 + 1}</{f}>" for i, f in enumerate(tx.SCORE_FIELDS)) + "</scores>"
    assert one(spark, tx.judge_scores("t"), t=full).asDict()["contribution_coverage"] == 2
    names = "contribution_accuracy contribution_coverage evidence_faithfulness evidence_self_contained evidence_concision overall"
    assert tx.SCORE_FIELDS == tuple(names.split())
    assert one(spark, tx.judge_reason("t"), t="<reason> a\n b </reason>") == "a\n b" and one(spark, tx.judge_reason("t"), t="x") is None
    assert one(spark, tx.judge_scores("t"), t=full.replace("<overall>1</overall>", "")) is None


def test_scripts(spark):
    assert one(spark, tx.dominant_script("t"), t="日本 ab") == "cjk"
    assert one(spark, tx.dominant_script("t"), t="12") == "unknown"
    assert one(spark, tx.language("t"), t="ひらがなです") == "Japanese"
    assert one(spark, tx.language("t"), t="한국어") == "Korean"
    assert one(spark, tx.same_script("a", "b"), a="abc", b="12")
    assert one(spark, tx.dominant_script("t"), t="éàü漢") == "cjk"
    assert one(spark, tx.same_script("a", "b"), a="漢字", b="<contribution>漢</contribution><EVIDENCE>字</EVIDENCE>")
    # the share is taken of all counted characters; without any the text counts as Chinese
    assert one(spark, tx.language("t"), t="漢" * 60 + "x" * 50 + "か" * 4) == "Chinese"
    assert one(spark, tx.language("t"), t="漢" * 60 + "か" * 4) == "Japanese"
    assert one(spark, tx.language("t"), t="12 Жж") == "Chinese" and one(spark, tx.language("t"), t="ab") == "English"


def test_truncation_keeps_the_text_itself(spark):
    assert one(spark, tx.truncated("t", 3), t="a,b\n\nc d") == "a,b"
    assert one(spark, tx.truncated("t", 4), t="a,b\n\nc d") == "a,b\n\nc"
    assert one(spark, tx.truncated("t", 5), t="a,b\n\nc d ") == "a,b\n\nc d "


def test_quota_and_query_rules(spark):
    assert one(spark, tx.quota_error("t"), t="Your QUOTA is Exhausted") and not one(spark, tx.quota_error("t"), t="quota") and not one(spark, tx.quota_error("t"), t="timeout")
    assert one(spark, tx.quota_error("t", "n"), t="x", n="ExaUsageLimitError")
    assert one(spark, tx.cut_query("t", 3), t="abcdef") == "abc"
    assert one(spark, tx.instructed("t", "m", "do: ", ("m",)), t="q") == "do: q" and one(spark, tx.instructed("t", "k", "do: ", ("m",)), t="q") == "q"


def test_keywords_and_quotes(spark):
    assert one(spark, tx.refused_keywords("t"), t=" skip ")
    assert one(spark, tx.refused_keywords("t"), t="a b c d e f g h")
    assert one(spark, tx.unquoted("t"), t="\"'x'\"") == "x"
    assert one(spark, tx.unquoted("t"), t="None") == "" and one(spark, tx.unquoted("t"), t="\" 'x' \"") == "x" and one(spark, tx.unquoted("t"), t="'") == ""


def test_numbered_list_pads_and_cuts(spark):
    assert one(spark, tx.numbered_list("t", 3, ["a", "b"], "?"), t="1. a\n2、 c") == ["a", "?", "?"]
    assert one(spark, tx.numbered_list("t", 1, ["a", "b"], "?"), t="1. b\n2. a") == ["b"]


def test_rendered_does_not_scan_values_again(spark):
    assert one(spark, tx.rendered("{{ q }}!", q=F.col("q")), q="{{ q }}") == "{{ q }}!"
    with pytest.raises(KeyError):
        tx.rendered("{{ z }}", q=F.lit(1))


def test_base64_and_names(spark):
    assert one(spark, tx.base64_run("t"), t="ab cdef!") == 4
    assert one(spark, tx.base64_run("t"), t="!!") == 0
    assert one(spark, tx.safe_name("t"), t="a/b:c d") == "a__b_c_d"
    assert one(spark, tx.model_name("t"), t="x/y/z") == "y/z"


def test_title_text(spark):
    assert one(spark, tx.title_text("a", "b"), a=" t ", b="x") == "t x"
    assert one(spark, tx.title_text(F.lit(None).cast("string"), F.lit(None).cast("string"))) == ""


def test_pair_key_counts_null_as_empty(spark):
    assert one(spark, hashing.pair_key(F.lit("q"), F.lit(None).cast("string"))) == hashlib.sha256(b"q\n").hexdigest()


def test_hash01_is_uniform_and_stable(spark):
    rows = spark.range(2000).select(hashing.hash01("s", "id").alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= rows[0] < 0.01 and 0.99 < rows[1] < 1 and abs(rows[2] - 0.5) < 0.03


def test_ndcg_candidates_and_ties(spark):
    scores, grades = F.array(F.lit(0.9), F.lit(0.1)), F.array(F.lit(0.0), F.lit(1.0))
    assert one(spark, metrics.ndcg(scores, grades)) == pytest.approx(1 / math.log2(3))
    assert one(spark, metrics.ndcg(scores, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    tied = F.array(F.lit(0.5), F.lit(0.9), F.lit(0.5))
    assert one(spark, metrics.ranked(tied, F.array(F.lit(1), F.lit(0), F.lit(0)))) == [0, 1, 0]


def test_match_is_null_safe(spark):
    nothing = F.lit(None).cast("string")
    assert one(spark, metrics.matches(nothing, nothing)) == "yes"


def test_softmax_of_missing(spark):
    assert one(spark, metrics.yes_probability(F.lit(0.0), F.lit(None).cast("double"))) == pytest.approx(1 / (1 + math.exp(-10)))


def test_strict_zip_raises(spark):
    a, b = F.array(F.lit(1), F.lit(2)), F.array(F.lit(1))
    with pytest.raises(Exception, match="different sizes"):
        one(spark, arrays.strict_zip(a=a, b=b))


def test_batches_by_budget(spark):
    sizes = F.array(*[F.lit(x) for x in (5, 5, 5, 30, 1)])
    assert one(spark, arrays.batches_by_budget(sizes, F.lit(1), 11, 10)) == [0, 0, 1, 2, 3]
    assert one(spark, arrays.batches_by_budget(sizes, F.lit(0), 1000, 2)) == [0, 0, 1, 1, 2]


def test_paired_filter_drops_blank_documents(spark):
    got = one(spark, arrays.paired_filter(F.array(F.lit("a"), F.lit(" "), F.lit("b")), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))))
    assert [(r["document"], r["grade"]) for r in got] == [("a", 1.0), ("b", 3.0)]
