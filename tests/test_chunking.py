import pytest
from pyspark.sql import functions as F

from sparkwell.operators import chunking as c

TEXT = "Hello world. This is a test."


@pytest.mark.parametrize(
    ("text", "size", "overlap", "want"),
    [
        (TEXT, 100, 0, [TEXT]), (TEXT, 3, 0, ["Hello world. This", "is a test."]), ("A B C D E", 3, 1, ["A B C", "C D E"]),
        ("P1 S1. P1 S2.\n\n\nP2 S1. P2 S2.", 2, 0, ["P1 S1.", "P1 S2.", "P2 S1.", "P2 S2."]), ("a,b c,d", 1, 0, ["a,", "b", "c,", "d"]), ("", 5, 0, [""]),
    ],
)
def test_sentence_splitter(text, size, overlap, want):
    assert c.split_sentences(text, size, overlap) == want


def test_every_word_is_in_a_chunk():
    text = " ".join(f"w{i}{',' if i % 7 == 0 else ''}" for i in range(500))
    for size, overlap in ((10, 0), (10, 3), (37, 12)):
        assert set(" ".join(c.split_sentences(text, size, overlap)).split()) == set(text.split())
        assert set(" ".join(c.split_tokens(text, size, overlap)).split()) == set(text.split())


def test_markdown_blocks_stay_whole():
    text = "# A\none two\n\n```py\nx = 1\ny = 2\n```\n## B\n" + "word " * 50
    chunks = c.split_markdown(text, 12)
    assert any("```py\nx = 1\ny = 2\n```" in x for x in chunks)
    assert sum(x.count("word") for x in chunks) == 50 and all(len(x.split()) <= 12 for x in chunks)


def test_sizes_are_checked():
    with pytest.raises(ValueError, match="overlap"):
        c.check_sizes(10, 10)
    with pytest.raises(ValueError, match="size"):
        c.check_sizes(0, -1)


def test_columns(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.c for r in df.select("doc_id", c.sentence_chunks(F.col("text"), 3, 0).alias("c")).collect()}
    assert got == {1: ["Hello world. This", "is a test."], 2: [], 3: [""]}
    n = {r.node_id: r for r in c.nodes(df, c.sentence_chunks(F.col("text"), 3, 0), F.create_map(F.lit("k"), F.lit("v"))).collect()}
    assert n["1-chunk-0"].next_id == "1-chunk-1" and n["1-chunk-1"].prev_id == "1-chunk-0" and n["1-chunk-1"].start_char == 17
    assert n["1-chunk-1"].metadata == {"k": "v", "chunk_index": "1", "chunk_count": "2"}
    assert df.select(c.prose_sentences(F.lit("One. Two! three? Four\n\nfive")).alias("s")).first().s == ["One.", "Two! three?", "Four", "five"]


def test_windows(spark):
    df = spark.createDataFrame([(1, "a. b. c. d.")], "doc_id long, text string")
    rows = {r.sentence_index: r for r in c.sentence_windows(df, 1).collect()}
    assert rows[0].window == "a. b." and rows[2].window == "b. c. d." and rows[3].original_sentence == "d."
