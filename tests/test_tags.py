"""Tag frequencies and pairs against brute force."""

from collections import Counter
from itertools import combinations

import __spark_entry__ as entry


def test_all_tags_and_pairs(spark, tmp_path):
    texts = ["a #x #Y b", "#y #x #x #z", "say that thing", "no tags", "", None, "#x", " ".join(f"#n{i}" for i in range(60))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = [{"x", "y"}, {"x", "y", "z"}, {"that", "thing"}, {"x"}, {f"n{i}" for i in range(60)}]
    expected = Counter((a, None) for s in sets for a in s) + Counter(p for s in sets for p in combinations(sorted(s), 2))
    found = entry.queries()["tag_frequencies_and_pairs"](spark, str(tmp_path)).collect()
    assert {(r.a, r.b): r.texts for r in found} == dict(expected) and len(found) == len(expected)
