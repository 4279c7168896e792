import corpus_pipeline
from sparklog.llm import mixing, quality_rules
from sparklog.llm.queries import tokenizer_file

from .helpers import SF, no_documents, odd_documents, table
from .test_decontaminate import brute
from .test_simhash import plain_components, plain_fingerprint


def test_stages_against_brute_force(spark, tmp_path):
    docs = table(spark, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "decontamination", "mixing", "token_output"]
    held, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        held = spark.read.parquet(str(tmp_path / name))
        kept.append({r["doc_id"]: r["text"] for r in held.collect()})
    verdict = {r["doc_id"]: r["q"]["kept"] for r in quality_rules.quality(docs, out="q").collect()}
    assert set(kept[0]) == {d for d, ok in verdict.items() if ok}
    prints = {d: plain_fingerprint(t) for d, t in kept[0].items()}
    assert set(kept[1]) == {d for d, c in plain_components(prints).items() if d == c}
    found = brute(kept[1].items(), [tuple(r) for r in table(spark, "benchmark").collect()])
    assert set(kept[2]) == {d for d, (_, hit, _) in found.items() if not hit}
    before = spark.read.parquet(str(tmp_path / "decontamination"))
    drawn = mixing.with_probabilities(before).filter(mixing.sampled())
    assert set(kept[3]) == {r["doc_id"] for r in drawn.collect()} and 0.6 < len(kept[3]) / len(kept[2]) <= 1
    assert all(t == dict_text for d, t in kept[3].items() for dict_text in [kept[2][d]])
    rows = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert [r[0] for r in rows] == sorted(kept[3])
    from .test_token_binary import want
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    assert rows == want(sorted(kept[3].items()), lambda x: t.encode(x or "", add_special_tokens=False).ids)


def test_odd_documents_pass_all_stages(spark, tmp_path):
    for docs in (odd_documents(spark, "n_chars string"), no_documents(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
