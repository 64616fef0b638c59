"""The pipeline's stages against plain versions, each on what the stage before kept."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from orbitrank.llm import mixing

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _sets(texts, words):
    made = {}
    for i, text in texts.items():
        own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        made[i] = {tuple(own[k:k + words]) for k in range(max(1, len(own) - words + 1))} if own else set()
    return made


def test_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    kept = []
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.collect())
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    languages, copies, mixed, encoded = kept

    # All documents are in a language that is taught.
    assert Counter(r["doc_id"] for r in languages) == Counter(list(before))
    assert all(r == before[r["doc_id"]] for r in languages)

    # One of each class of near copies, the lowest id.
    texts = {r["doc_id"]: r["text"] for r in languages}
    sets, root = _sets(texts, 5), {i: i for i in texts}
    where = defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for g in sets[i] for j in where[g])
        for j, n in common.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = i, j
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)
        for g in sets[i]:
            where[g].append(i)
    assert sorted(r["doc_id"] for r in copies) == sorted(i for i in root if root[i] == i)

    # Every document as often as the report says, which has SQL of its own.
    report = mixing.mix_report(spark.createDataFrame(copies, docs.sparkSession.read.parquet(
        f"{tmp_path}/{pipeline.STAGES[1][0]}").schema)).collect()
    assert Counter(r["doc_id"] for r in mixed) == Counter({r["doc_id"]: r["repeats"] for r in report if r["repeats"]})
    assert all(r == before[r["doc_id"]] for r in mixed)

    # Every row encoded as the library does.
    library = Tokenizer.from_file(pipeline.TOKENIZER)
    wanted = Counter()
    for r in mixed:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        wanted[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
               hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert Counter(map(tuple, encoded)) == wanted
    assert Counter(map(tuple, pipeline.run(spark, sf_dir).collect())) == wanted
