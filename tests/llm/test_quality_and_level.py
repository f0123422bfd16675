"""Quality figures and reading levels."""

import pyspark.sql.functions as F
import pytest

from proofline.llm import quality, readability

PROSE = "The old man walked to the river because he wanted to see the boats. His daughter followed him, and she carried a basket with bread for the two of them. "
FRENCH = "Le vieil homme marchait vers la rivière parce qu'il voulait voir les bateaux. Sa fille le suivait avec un panier de pain, et le chien courait devant eux dans les champs. " * 2


def _judge(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumns({"n_words": F.lit("clash"), "kind": F.lit(0)})
    return {r.doc_id: r for r in quality.quality(df).collect()}


def test_verdicts(spark):
    texts = [
        PROSE * 3, PROSE.upper(), PROSE.replace(".", "").replace(",", ""), PROSE.replace("a", "а").replace("e", "е​"), PROSE * 2 + "\n- red pen\n- blue pen\n" + PROSE,
        "- red pen\n- blue pen 3\n- green ink\n- dry paper", "size: big red | maker: mill | colour: blue | grade: four", "a\tb\tc\nx\t12.5\t3\ny\t14\t5\nz\t1\t2", "@#$% ^&*[] {}|| ~~<> #$%",
        "bcd fgh jklm npqr stvw", None, "", "   ", "\n".join(f"- {PROSE}" for _ in range(12)), FRENCH, "𝐓𝐡𝐞 𝐨𝐥𝐝 𝐦𝐚𝐧 𝐟𝐞𝐝 𝐭𝐡𝐞 𝐝𝐨𝐠 𝐚𝐧𝐝 𝐭𝐡𝐞 𝐜𝐚𝐭", "The ﬁsh of the ﬂock and the ﬂeet",
    ]
    got = _judge(spark, texts)
    assert [got[i].is_prose for i in range(len(texts))] == [True] * 5 + [False] * 9 + [True] * 3
    assert [got[i].kind for i in (5, 6, 7, 8, 10)] == ["list", "fields", "table", "junk", "junk"]
    assert got[10].reasons == got[11].reasons == ["empty"] and got[10].mean_word_length is None
    assert "stop_words" in got[5].reasons and "bullet_lines" in got[5].reasons and got[0].reasons == [] and got[0].passes
    assert got[13].kind == "list" and got[13].reasons == ["bullet_lines"]
    assert "terminal_lines" in got[2].reasons and not got[2].passes
    assert got[16].mean_word_length == pytest.approx((3 + 4 + 2 + 3 + 5 + 3 + 3 + 5) / 8)


def test_figures(spark):
    r = _judge(spark, ["The cat sat.\n* one\nWhat? #tag"])[0]
    assert (r.n_words, r.n_lines, r.n_stop_words) == (6, 3, 1)
    assert r.bullet_line_share == pytest.approx(1 / 3) and r.terminal_line_share == pytest.approx(1 / 3)
    assert r.mean_word_length == pytest.approx((3 + 3 + 3 + 3 + 4 + 3) / 6)


EASY, HARD = "the cat sat on the mat and the dog ran to the big red barn", "the institutional parametrisation of the heterogeneous methodology was approximated within the jurisdictional administration"


def test_levels_follow_the_grades(spark):
    docs = [(i, (EASY if i % 2 else HARD) + f" and the {'sun' if i % 2 else 'periodicity'} of it") for i in range(60)] + [(100, "le chat est dans la maison avec son ami"), (101, None), (102, ""), (103, "- red pen\n- blue pen")]
    grades = spark.createDataFrame([(i, "r", 1 if i % 2 else 4) for i in range(10)] + [(0, "r2", 3), (3, "r2", None), (999, "r", 2)], "doc_id bigint, rater string, level int")
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"score": F.lit(1), "nodes": F.lit("x"), "grade": F.lit(2)})
    got = {r.doc_id: r for r in readability.reading_levels(df, grades).collect()}
    assert set(got) == set(range(60))
    assert all(got[i].level == 4 for i in range(0, 60, 2)) and all(got[i].level < 3 for i in range(1, 60, 2))


def test_every_document_has_a_row(spark, tmp_path):
    from proofline.llm import queries

    docs = [(0, HARD), (1, EASY), (2, EASY), (100, "le chat est dans la maison avec son ami"), (101, None), (102, ""), (103, "- red pen\n- blue pen"), (104, "?! ..."), (105, "a 1 a 2 a")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "r", 4), (1, "r", 1), (100, "r", 2)], "doc_id bigint, rater string, level int").write.parquet(f"{tmp_path}/level_labels.parquet")
    rows = queries.p9_levels(spark, str(tmp_path)).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) and set(got) == {i for i, _ in docs}
    assert all(got[i].level is not None and got[i].score is not None and got[i].reason is None for i in (0, 1, 2))
    why = {100: "not_english_prose", 101: "no_words", 102: "no_words", 103: "not_english_prose", 104: "no_words", 105: "not_english_prose"}
    assert {i: (got[i].score, got[i].level, got[i].reason) for i in why} == {i: (None, None, r) for i, r in why.items()}
    without = readability.document_levels(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.createDataFrame([], "doc_id bigint, level int")).collect()
    assert {r.doc_id: (r.level, r.reason) for r in without} == {i: (None, why.get(i, "no_grades")) for i, _ in docs}


def test_without_grades_or_texts(spark):
    grades = spark.createDataFrame([], "doc_id bigint, rater string, level int")
    df = spark.createDataFrame([(1, EASY)], "doc_id bigint, text string")
    assert [(r.score, r.level) for r in readability.reading_levels(df, grades).collect()] == [(None, None)]
    assert readability.reading_levels(df.limit(0), grades).count() == 0


def test_held_out_accuracy(spark):
    """Grades of every fifth graded document are held back; their level 4 is found among graded prose."""
    import os

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("test tables are not here")
    docs, grades = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/level_labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    levels = readability.reading_levels(docs, grades.filter(~held))
    truth = grades.filter(held & F.col("level").isNotNull()).groupBy("doc_id").agg((F.avg("level") >= 3.5).alias("hard"))
    r = truth.join(levels, "doc_id").agg(F.count_if(F.col("hard") & (F.col("level") == 4)).alias("tp"), F.count_if(F.col("hard") != (F.col("level") == 4)).alias("wrong"), F.count("*").alias("n")).first()
    assert r.n > 100 and r.wrong / r.n < 0.08 and r.tp > 0
