import glob

import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts():
    """doc_id -> text of the smallest driver table."""
    table = pq.read_table(glob.glob(f"{SF}/documents.parquet")[0])
    return dict(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))


@pytest.fixture(scope="session")
def odd_texts():
    """Shapes that a small table must survive: null, empty, blanks, specials, other scripts."""
    return [None, "", "a", " a", "a ", "  a  b", "a\n b \nc\n\nd", "Σ ΑΣ. é x'll I'M can't 12 3a ½ ×", "<|endoftext|> x<|startoftext|>y", "a b  c \x1cd \x85e", "\n\n", "foo.\nBar\tbaz,,  qux--", "日本語 text 12345 !?", "don't ' s 's", "é İ ẞ ſ K", "aaaa aaaaa aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 5000, "same", "same"]
