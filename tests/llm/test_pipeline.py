from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from cairn.llm import quality
from cairn.llm.common import materialize, read
from tests.llm.test_secrets import plain as plain_secrets
from tests.llm.test_simhash import plain_kept

SF = "/root/testdata/sf0.001"


def test_run_against_plain_python(spark):
    docs = read(spark, SF, "documents")
    step = {"": {r.doc_id: r.text for r in docs.collect()}}
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = materialize(stage(spark, seen, SF))
        assert out.columns == docs.columns
        rows = out.collect()
        step[name] = {r.doc_id: r.text for r in rows}
        copies = Counter(r.doc_id for r in rows)
        assert name == "mixture" or max(copies.values()) == 1
        seen = out
    trees = quality.fit(docs, read(spark, SF, "labels"))
    kept = {r.doc_id for r in quality.judge(docs, trees).filter("kept").collect()}
    assert step["quality"].keys() == kept
    assert step["near_duplicates"].keys() == plain_kept(step["quality"])
    for i, text in step["near_duplicates"].items():
        want, at = "", 0
        for a, _, b in plain_secrets(text):
            if a >= at:
                want += text[at:a] + "[SECRET]"
            at = max(at, b)
        assert step["secrets"][i] == want + text[at:]
    total = sum(len(t.encode().split()) for t in step["secrets"].values())
    assert abs(sum(copies[i] * len(step["secrets"][i].encode().split()) for i in copies) - 1.5 * total) < 0.2 * total
    assert max(copies.values()) <= 2
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == copies
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(step["secrets"][r.doc_id], add_special_tokens=False).ids
