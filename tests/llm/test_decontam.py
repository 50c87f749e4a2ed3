from fixtures import clash, docs, odd_rows, words

from corpus_curator.llm import decontam


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_finds_items_in_long_documents(spark):
    items = [(i, " ".join(words(12 + 5 * i, 300 + i, 9000))) for i in range(8)]
    items += [(90, "only four words here"), (91, ""), (92, None), (93, "solo")]
    rows = []
    for i, text in items[:8]:
        w = text.split()
        rows.append((i, " ".join([*words(4000, i), *w, *words(3000, 70 + i)])))
        w[len(w) // 2:len(w) // 2] = ["inserted"]  # breaks four shingles
        rows.append((100 + i, " ".join([*words(500, i), *w])))
        rows.append((200 + i, " ".join([*words(50, i), *w[:len(w) // 2], *words(50, i + 1)])))
    rows += [(500, "x ONLY, four words here. y"), (501, "only four words"), *odd_rows()]

    def grams(text, k):
        w = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}

    want = []
    for item, text in items:
        k = min(5, len((text or "").split()))
        q = grams(text, k) if k else set()
        for doc_id, body in rows:
            if q and 100 * len(q & grams(body, k)) >= 80 * len(q):
                want.append((doc_id, item, len(q), len(q & grams(body, k))))
    got = decontam.find_items(clash(docs(spark, rows)), bench(spark, items + items[:2]))
    assert sorted((r.doc_id, r.item_id, r.n_shingles, r.matched) for r in got.collect()) \
        == sorted(want)
    left = decontam.decontaminate(docs(spark, rows), bench(spark, items))
    gone = {d for d, *_ in want}
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(
        str(d) for d, _ in rows if d not in gone)
    assert left.columns == docs(spark, rows).columns


def test_empty_tables(spark):
    assert decontam.find_items(docs(spark, []), bench(spark, [(1, "a b c d e f")])).collect() == []
    assert decontam.find_items(docs(spark, [(1, "a b c d e f")]), bench(spark, [])).collect() == []


def test_sketch_guarantees_a_hit():
    for n in range(1, 200):
        most_missing = n - -(-n * 80 // 100)
        assert decontam.sketch_size(n, 80) > most_missing
