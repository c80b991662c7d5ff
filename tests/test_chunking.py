import pytest

from lodestream.functions.headings import NOVEL, Promotion, promote, title_after
from lodestream.operators import chunking as c
from lodestream.operators.chunking import ChunkOptions, chunk_text


def bodies(text, **options):
    return [r[5] for r in chunk_text("doc", text, ChunkOptions(**options))]


def test_accumulates_until_full():
    text = "\n\n".join(["word " * 8 + "end"] * 6)
    got = chunk_text("doc", text, ChunkOptions(least=20, most=100, margin=0.0))
    assert [len(r[5]) for r in got] == [88, 43, 88, 43] and [r[1] for r in got] == [0, 1, 2, 3]
    assert all(r[4] == "[doc]" and r[6].startswith("[doc]\n\n") for r in got)


@pytest.mark.parametrize(("line", "mark"), [("| a | b |", "TABLE"), ("- an item of some length", "LIST")])
def test_long_blocks_are_split_and_marked(line, mark):
    got = bodies("intro\n\n" + "\n".join([line] * 60) + "\n\nend", least=10, most=200)
    assert got[0] == "intro" and got[1].startswith(f"[{mark}:start]\n") and got[1].endswith(f"\n[{mark}:cont]")
    assert got[-2].endswith(f"[{mark}:end]") and got[-1] == "end"


def test_sentences_are_kept_whole():
    got = bodies("This is a sentence. " * 30 + "x" * 300, least=10, most=120, margin=0)
    assert all(len(g.split("\n")[1]) <= 120 for g in got[:-1]) and "x" * 300 in got[-1]


def test_heading_paths_and_flush():
    text = "# A\n\n" + "p " * 30 + "\n\n## B\n\n" + "q " * 30 + "\n\n## C\n\n" + "r " * 30
    got = chunk_text("doc", text, ChunkOptions(least=20, most=100))
    assert [r[2] for r in got] == ["A", "A > B", "A > C"]
    assert chunk_text("doc", text, ChunkOptions(least=1000, most=2000))[0][2] == "A"


def test_sheets_break():
    assert [r[2] for r in chunk_text("d", "[Sheet: one]\n\na\n\n[Sheet: two]\n\nb")] == ["one", "two"]


def test_offsets():
    got = chunk_text("d", "é same\n\nother\n\né same", ChunkOptions(least=0, most=8, margin=0, running_offsets=True))
    assert [r[10] for r in got] == [0, 9, 16]
    assert [r[10] for r in chunk_text("d", "é same\n\nother\n\né same", ChunkOptions(least=0, most=8, margin=0))] == [0, 9, 0]


def test_options_are_checked():
    with pytest.raises(ValueError):
        ChunkOptions(least=10, most=5)


def test_common_path():
    assert c.common_path([["a", "b"], ["a", "c"]]) == ["a"]
    assert c.common_path([["a"], [], ["b", "c"]]) == ["b", "c"]
    assert c.common_path([]) == []


def test_merge_blocks():
    assert c.merge_blocks(["|a|b|", "|c|d|", "", "|e|f|", "- x", "- y", "p"], "\n") == ["|a|b|\n|c|d|", "", "|e|f|", "- x\n- y", "p"]


def test_promotion():
    assert promote("Text here. What is it? It is this.", Promotion(phrases=False)) == "Text here.\n\n## What is it?\n\nIt is this."
    assert promote("One? Two? Three.", Promotion(phrases=False)) == "One?\n\n## Two?\n\nThree."
    assert "## Signs and symptoms" in promote("It ended. Signs and symptoms Basal cells grow.")
    assert promote("a  CHAPTER I. THE START It was.", Promotion(questions=False, phrases=False, levels=tuple(NOVEL))) == "a \n\n## CHAPTER I: THE START\n\nIt was."
    assert "#" not in promote("CHAPTER I x CHAPTER II y", Promotion(levels=tuple(NOVEL)))
    assert title_after("x. - THE END, he said", 1) == ("THE END", 14)


def test_dataframe_forms(spark):
    df = spark.createDataFrame([("a", "x\n| 1 | 2 |\n| 3 | 4 |\n\n- l\n- m"), ("b", None), ("c", ""), (None, "t")], "name string, text string")
    assert sorted(tuple(r) for r in c.chunk(df).select("document_name", "body").collect()) == [("", "t"), ("a", "x\n| 1 | 2 |\n| 3 | 4 |\n\n- l\n- m")]
    got = c.merged_lines(df.where("name = 'a'"), "name").orderBy("block").collect()
    assert [(r.kind, r.n_lines) for r in got] == [("prose", 1), ("table", 2), ("blank", 1), ("list", 2)]
    assert [r.n_tokens for r in c.token_windows(spark.createDataFrame([("a", "w " * 10)], "k string, text string"), "k", size=4, overlap=1).orderBy("window").collect()] == [4, 4, 4, 1]
