"""ORC token files against the tokenizers library."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from dossier.llm import token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = [
    "", None, " ", "  \n\t ", "a  b   c", "don't we'll it's 'quoted'", "x y　z", "tab\tnew\r\n  line", "end  ", "<|endoftext|>", "a <|endoftext|> b<|endof",
    "Größe é  à", "\u0085next line", "a\x1c b\x1d  c", "one,two (x) _y_ it's-a.b\nNext\n\nLine \nz", "你好 世界 １２３", "🤷‍♂️🏽 !!! ...", "\u0000\u0001", "x" * 3000, "12345 67", "a​ b", "＇s 's",
]


def expected(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_digests_equal_the_library(spark, monkeypatch):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice([" ", "  ", "\n", "a", "bc", "é", ".", "'s", "7", " "]) for _ in range(rng.randrange(60))) for _ in range(400)]
    rows = [(3 * i - 40, t) for i, t in enumerate(texts)]
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in shuffled], "doc_id long, text string, ids string, part int")
    for piece, held, part in ((8 << 20, 64 << 20, 1 << 20), (64, 100, 1000)):
        monkeypatch.setattr(token_files, "PIECE", piece)
        monkeypatch.setattr(token_files, "PART", part)
        monkeypatch.setattr(token_files, "REMEMBERED", held)
        got = token_files.token_digests(df.repartition(3)).orderBy("doc_id").collect()
        assert [tuple(r) for r in got] == expected(rows)


def test_null_and_repeated_ids_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(token_files, "PART", 500)
    rows = [(None, "b"), (None, None), (7, "same"), (7, "same"), (7, "other"), (2, "x y")] + [(9, "again and again")] * 300
    got = [tuple(r) for r in token_files.token_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    sizes = lambda found: sorted((d is not None, d or 0, n, c) for d, _, n, c in found)
    assert sizes(got) == sizes(expected(rows))
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, 2, 7, 7, 7] + [9] * 300
    assert [r[1] for r in got] == [sum(r[2] for r in got[:i]) for i in range(len(got))]
    assert token_files.token_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_files_prune_by_document(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "PART", 20_000)
    from pyarrow import orc

    df = spark.range(6000).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"))
    folder = token_files.write_tokens(df, str(tmp_path / "t"))
    one = token_files.find(spark, folder, [4242, 4243])
    assert [(r.doc_id, len(r.ids), r.ids[-1]) for r in one.collect()] == [(4242, one.first().n_tokens, 2)]
    assert "PushedFilters: [In(doc_id, [4242,4243])" in one._jdf.queryExecution().toString().replace("IsNotNull(part), ", "")
    parts = spark.read.orc(folder + "/parts").orderBy("part").collect()
    assert sum(r.n_docs for r in parts) == 6000 and all(a.last_doc < b.first_doc for a, b in zip(parts, parts[1:]))
    file = orc.ORCFile(next((tmp_path / "t" / "tokens").glob("*.orc")))
    assert file.row_index_stride == token_files.STRIDE and file.nstripes >= 1
