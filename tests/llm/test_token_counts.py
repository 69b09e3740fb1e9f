import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_counts(documents, messy, nothing):
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted((-1 if i is None else i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 100) for i, t in messy)
    got = token_counts.count_tokens(documents, PATH, limit=100).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], *r[1:]) for r in got) == want
    assert token_counts.count_tokens(nothing, PATH).count() == 0


def test_odd_texts():
    tokenizer, counter = Tokenizer.from_file(PATH), token_counts.Counter(PATH)
    for t in ("a\x1cb \x1c c", "don't I'LL we've x'", "ΣΑΣ İı ﬁ é é ​", "<|startoftext|>x<|endoftext|>", "á ́b", "１２ ٣٤", "ab" * 2000):
        assert counter.count(t) == len(tokenizer.encode(t, add_special_tokens=False).ids), t


def test_merges_in_rank_order():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("a", "bc"): 2, ("abc", "abc"): 3}
    assert token_counts.merge_count(list("abcabc"), ranks) == 5
    assert token_counts.merge_count(list("ab"), ranks) == 1
    assert token_counts.merge_count(["x"], ranks) == 0
