import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.llm.split import SIZE, pieces, resequenced, split_oversized


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,\n。é📁", max_size=400), st.integers(2, 40), st.data())
def test_pieces_fit_overlap_and_round_trip(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    cut = pieces(text, size, overlap)
    assert all(0 < len(p) <= size for p in cut)
    assert "".join([cut[0], *(p[overlap:] for p in cut[1:])]) == text if cut else text == ""
    assert all(not overlap or a[-overlap:] == b[:overlap] for a, b in zip(cut, cut[1:]))


def test_cuts_at_natural_boundaries():
    text = ("One sentence here. " * 30).strip() + "\n\n" + "Another one there. " * 30
    assert pieces(text, 700, 50)[0].endswith("\n\n")


def test_long_text_without_boundaries():
    cut = pieces("x" * 100_000, 1024, 128)
    assert max(map(len, cut)) <= 1024 and len(cut) == -(-(100_000 - 128) // 896)


def test_parameters_are_checked():
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            pieces("abc", size, overlap)


def test_rows(spark):
    rows = [(1, "a" * 2000, "of"), (2, None, None), (3, "", "x"), (4, "b" * SIZE, "y"), (1, "a" * 2000, "of")]
    df = spark.createDataFrame(rows, "chunk_id long, text string, piece string")
    out = split_oversized(df).collect()
    assert sorted((r.chunk_id, r.piece, r.of) for r in out) == [(1, 0, 3)] * 2 + [(1, 1, 3)] * 2 + [(1, 2, 3)] * 2
    assert split_oversized(df.limit(0)).count() == 0


def test_sequence_is_gapless(spark):
    rows = [("c", i, "h", "w " * (900 if i % 3 == 0 else 5)) for i in range(40)] + [(None, 0, None, "x"), ("c", 40, "h", None), ("d", None, "", "y"), ("d", 1, "", "")]
    out = resequenced(spark.createDataFrame(rows, "content_digest string, seq int, heading string, text string"), span=7).collect()
    own = sorted((r.seq, r.source_seq, r.piece) for r in out if r.content_digest == "c")
    assert [s for s, _, _ in own] == list(range(len(own))) and [x[1:] for x in own] == sorted(x[1:] for x in own)
    assert len([r for r in out if r.content_digest is None]) == 1 and all(r.heading == "h" for r in out if r.content_digest == "c")
