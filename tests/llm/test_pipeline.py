import collections
import re
import zlib

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.test_decontaminate import brute as windows
from tests.llm.test_neardup import bag, components, similar
from tests.llm.test_quality import brute as quality_scores

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n.split("_")[0] for n, _ in cp.STAGES] == ["quality", "minhash", "suffix", "benchmark", "best"]
    frames = [docs]
    for _, stage in cp.STAGES[:-1]:
        frames.append(spark.createDataFrame(stage(spark, frames[-1], SF).collect(), docs.schema))
        assert frames[-1].columns == docs.columns
    texts = [{r["doc_id"]: r["text"] for r in f.collect()} for f in frames]
    # near duplicates: exactly the smallest of each class stays
    of = components({i: bag(t) for i, t in texts[1].items()}, similar)
    assert texts[2] == {i: t for i, t in texts[1].items() if of[i] == i}
    assert texts[3] == dict(without_repeats(texts[2].items())) and texts[3] != texts[2]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert texts[4] == dict(without_benchmark(texts[3].items(), items))
    pieces = cp.run(spark, SF).collect()
    assert {r["doc_id"] for r in pieces} == set(texts[4])


WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


@pytest.fixture(scope="module")
def folder(spark, messy, tmp_path_factory):
    """Labels of both kinds, conflicting, null and for unknown ids; items that stand in documents, a short one, empty ones, a repeated one."""
    path = tmp_path_factory.mktemp("tables")
    texts = dict(messy)
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] + [(1, 0), (2, None), (None, 1), (3, 7), (999, 1)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    items = [(1, " ".join(texts[0].split()[2:20])), (2, None), (3, ""), (4, " ".join(texts[5].split()).upper()), (5, "Two Words"), (6, "never seen"), (6, "never seen")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), items


def whole(data, a, b):
    """Words of data[a:b] that do not go on beyond it."""
    return sum(1 for m in WORD.finditer(data) if a <= m.start() and m.end() <= b)


def without_repeats(rows, length=cp.PASSAGE_BYTES, least=cp.PASSAGE_WORDS):
    seen = collections.Counter(d[i : i + length] for d in ((t or "").encode() for _, t in rows) for i in range(len(d) - length + 1))
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if seen[data[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = [m.span() for m in re.finditer(b"\1+", bytes(gone)) if whole(data, *m.span()) >= least]
        kept = b"".join(data[a:b] for a, b in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(data)])).decode("utf-8", "ignore")
        if not runs or kept.strip():
            yield i, None if t is None else kept


def without_benchmark(rows, items):
    norm = lambda t: [m[0].lower() for m in WORD.finditer((t or "").encode())]
    asked = [(str(k), norm(t)) for k, t in items]
    for i, t in rows:
        data, w = (t or "").encode(), norm(t)
        hit, _ = windows(asked, w, 10)
        places = [m.span() for m in WORD.finditer(data)]
        if len(hit) > 0.5 * len(w):
            continue
        out, at = b"", 0
        for k in sorted(hit):
            if k - 1 not in hit:
                out += data[at : places[k][0]]
            at = places[k][1]
        yield i, None if t is None else (out + data[at:]).decode()


def rows_of(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=repr)


def test_each_stage_against_brute_force(spark, documents, messy, folder):
    """Nulls, empty and long texts, ties, repeated rows and columns of clashing names; each stage on all that the stage before kept."""
    path, items = folder
    labels = [tuple(r) for r in spark.read.parquet(f"{path}/labels.parquet").collect()]
    kept = [row for row, p in zip(messy, quality_scores(messy, labels)) if p >= 0.3]
    first = cp.quality_filter(spark, documents, path)
    assert first.columns == documents.columns and first.first()["score"] == "z" and rows_of(first) == sorted(kept, key=repr)
    frame = spark.createDataFrame([(i, t, *(["z"] * (len(documents.columns) - 2))) for i, t in messy], documents.schema)
    passages = cp.repeated_passages(spark, frame, path)
    want = list(without_repeats(messy))
    assert passages.columns == documents.columns and rows_of(passages) == sorted(want, key=repr) and 0 < len(want) < len(messy)
    assert sum(len(t or "") for _, t in want) < sum(len(t or "") for _, t in messy)
    clean = cp.benchmark_passages(spark, frame, path)
    want = list(without_benchmark(messy, items))
    assert clean.columns == documents.columns and rows_of(clean) == sorted(want, key=repr) and 0 < len(want) < len(messy)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = collections.Counter()
    for i, t in messy:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        pieces.update((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    packed = cp.pack(spark, frame, path).collect()
    assert collections.Counter(tuple(r[:5]) for r in packed) == pieces
    places = collections.defaultdict(list)
    for r in packed:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in p) <= 1024 and [a for a, _ in sorted(p)] == list(np.cumsum([0, *(n for _, n in sorted(p))])[:-1]) for p in places.values())


def test_stages_on_empty_tables(spark, folder):
    path, _ = folder
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long, label string")
    for _, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), docs.schema)
        assert docs.count() == 0
    assert cp.pack(spark, docs, path).count() == 0


def test_queries_leave_the_session_as_it_is(spark):
    """No query changes a setting of the session."""
    from tessera.llm import queries

    settings = lambda: {k: v for k, v in spark.conf.getAll.items()}
    before = settings()
    for query in queries.QUERIES.values():
        query(spark, SF).count()
        assert settings() == before


def test_names_with_dots(spark):
    """Columns of any name go along through the stages that cut texts."""
    from tessera.llm import decontaminate, substrings

    passage = " ".join(f"word{i}" for i in range(120))
    docs = spark.createDataFrame([(1, passage + " a", "x", 1), (2, "b " + passage, "y", 2), (3, "short", None, 3)], "doc_id long, text string, `a.b` string, `row.text` int")
    items = spark.createDataFrame([(1, "some other benchmark item of more than ten words in a row here"), (2, " ".join(f"word{i}" for i in range(20)))], "item_id long, text string")
    kept = substrings.remove_repeats(docs, length=200).collect()
    assert {(r["doc_id"], r["a.b"], r["row.text"]) for r in kept} == {(1, "x", 1), (2, "y", 2), (3, None, 3)} and all(len(r["text"]) < 300 for r in kept)
    for block in (100_000, 5):
        clean = decontaminate.remove(docs, items, block_words=block)
        assert clean.columns == docs.columns
        assert {(r["doc_id"], r["a.b"], r["row.text"], "word5 " in r["text"]) for r in clean.collect()} == {(1, "x", 1, False), (2, "y", 2, False), (3, None, 3, False)}
