"""Repeated words, own repeats, many languages, long conversations and articles whose class words mislead."""

import time

import pytest
from pyspark.sql import functions as F

from tempofact.llm import chat, decontam, htmlcut, langid, queries, sentdedup

PROSE = "".join(f"<p>This is paragraph number {i} of an article, with words enough to be read as prose by anybody, and it ends well.</p>" for i in range(5))


def test_repeated_words_take_no_pairs_of_places():
    index = decontam.Items([("a", b"same " * 3000), ("b", b"other words that are not there at all in any document here")])
    began = time.time()
    got = index.spans([b"same"] * 20_000)
    assert time.time() - began < 2
    assert got == [(0, 0, 20_000)]


@pytest.mark.parametrize("text", ["x y " * 40, "x " * 9 + "y " + "x " * 30, "x x x y " * 12 + "z " + "x x y x " * 9])
def test_repeats_are_hit_as_windows_say(text):
    item = ("x x x x x x x x x x x x y x y x y x y x y x y x x x y x x x y x x x y " * 2).split()
    words = text.encode().split()
    windows = {tuple(item[i : i + 10]) for i in range(len(item) - 9)}
    want = set()
    for i in range(len(words) - 9):
        if tuple(w.decode() for w in words[i : i + 10]) in windows:
            want |= set(range(i, i + 10))
    got = decontam.Items([("a", " ".join(item).encode())]).spans(words)
    assert {p for _, a, b in got for p in range(a, b)} == want


def test_own_repeats_go_in_the_query(spark, tmp_path):
    run = "One sentence of some eleven words that is here to be repeated. And another one that makes the run long enough to count."
    df = spark.createDataFrame([(1, f"{run} Something else between them. {run}"), (2, "Nothing that is repeated here at all.")], "doc_id bigint, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op5_sentence_dedup(spark, str(tmp_path)).collect()}
    assert got[1].n_removed == 2 and got[1].text == f"{run} Something else between them." and not got[2].changed


def test_more_than_five_hundred_languages(spark):
    rows = [(i * 1000 + j, " ".join([f"{chr(0x4E00 + i)}{chr(0x4E01 + i)}{chr(0x5E00 + i)}"] * 5), f"l{i:03}") for i in range(600) for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = langid.identify(docs, langid.fit(docs))
    assert got.select("lang_pred").distinct().count() == 600 and got.where("lang_pred <> lang").count() == 0


def test_long_conversation_is_read_back_in_linear_time(spark):
    said = spark.range(6000).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t<|im_end|>"), F.col("id")).alias("text"))
    none = spark.createDataFrame([(None, None, None, None), (2, 0, "assistant", "")], "conv_id bigint, turn bigint, role string, text string")
    began = time.time()
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat.events_of(said.unionByName(none)))).collect()}
    assert time.time() - began < 40
    assert [t.text for t in got[1].turns] == [f"t<|im_end|>{i}" for i in range(6000)] and got[1].loss_texts == [f"t<|im_end|>{i}" for i in range(1, 6000, 2)]
    assert [(t.role, t.text) for t in got[None].turns] == [("", "")] and got[None].loss_texts == [] and got[2].loss_texts == [""]


@pytest.mark.parametrize("opening, closing", [('<article class="post newsletter">', "</article>"), ('<div class="share-price-report">', "</div>"), ('<main class="notice-page">', "</main>"), ('<div class="main-related">', "</div>")])
def test_a_class_word_loses_no_article(opening, closing):
    page = f'<html><body><nav><a href="/">Home</a></nav>{opening}{PROSE}{closing}<div class="related-posts">{PROSE}</div></body></html>'
    assert htmlcut.main_text(page)[0].count("\n") == 4


@pytest.mark.parametrize("name", ["related-posts", "ad-container", "newsletter-signup", "post-comments", "cookie-notice", "sponsored-content", "share", "comment", "ad-300-250"])
def test_parts_by_name_stay_out(name):
    page = f'<html><body><main><p>The article itself has one paragraph that is long enough to be kept as it is, and more.</p><div class="{name}">{PROSE}</div></main></body></html>'
    assert "\n" not in htmlcut.main_text(page)[0]
