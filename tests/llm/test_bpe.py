import random

import public_tokenizers
import pytest
import regex
import tiktoken
from cases import frame, sha, texts
from hypothesis import given, settings
from hypothesis import strategies as st

from signalspark.llm import bpe
from signalspark.llm.queries import VOCABULARY

PATH, PATTERN = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_round_trip_matches_the_library(spark, library):
    rows = texts()
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.token_digests(frame(spark, rows), vocabulary=PATH, pattern=PATTERN).collect()}
    assert got == {(i, len(ids), sha(" ".join(map(str, ids))), sha(t or "")) for i, t in rows for ids in [library.encode_ordinary(t or "")]}
    docs = frame(spark, rows).selectExpr("*", "1 AS n_tokens")
    assert bpe.token_digests(docs, vocabulary=PATH, pattern=PATTERN).columns == [*docs.columns[:-1], "n_tokens", "ids_sha256", "decoded_sha256"]
    assert bpe.token_digests(docs.limit(0), vocabulary=PATH, pattern=PATTERN).count() == 0


def test_encode_and_decode_columns(spark):
    docs = frame(spark, texts())
    again = docs.select("text", bpe.decode(bpe.encode("text", PATH, PATTERN), PATH, block=3).alias("back"))
    assert again.filter("coalesce(text, '') != back").count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab the\n  \t'sé日😀‍$12ZĂ \x1c\x85"), max_size=60))
def test_any_text(library, text):
    ids = bpe.transducer(PATH).encode(text, regex.compile(PATTERN))
    assert ids.tolist() == library.encode_ordinary(text) and bpe.transducer(PATH).decimal(ids) == " ".join(map(str, ids.tolist()))


def test_few_states_and_little_memory(library):
    machine = bpe.Transducer(bpe.load_ranks(PATH), max_states=50, max_memo=20)
    rng = random.Random(2)
    for _ in range(200):
        text = " ".join("".join(rng.choice("abcdeing") for _ in range(rng.randint(1, 12))) for _ in range(8))
        assert machine.encode(text, regex.compile(PATTERN)).tolist() == library.encode_ordinary(text)
        assert len(machine.young) + len(machine.old) <= 20


@settings(max_examples=400, deadline=None)
@given(st.lists(st.binary(max_size=4), max_size=8))
def test_incremental_utf8(parts):
    stream = bpe.Utf8Stream()
    assert "".join([*map(stream.push, parts), stream.close()]) == b"".join(parts).decode("utf-8", "replace")


@pytest.mark.parametrize("pattern", [r"\S+|\s+", r" ?[a-z]+|.", r"(?s).{1,5}"])
def test_other_patterns_match_the_library(pattern):
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    for text in [*(t or "" for _, t in texts()), "a bc", "the  house, of \n gold"]:
        assert bpe.transducer(PATH).encode(text, regex.compile(pattern)).tolist() == other.encode_ordinary(text)
