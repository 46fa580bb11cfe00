"""The training-data operators: brute force, round trips, held-out accuracy and odd tables."""

from __future__ import annotations

import collections
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gleaner.llm import exact_dedup, html_cut, mixing, near_dup, packing, pii, quality, sharding, tokens, topk, toxicity
from gleaner.llm.common import components, drawn
from gleaner.session import stored

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target string"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def odd_rows():
    """Missing values, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    long = " ".join(f"w{at % 977}" for at in range(30_000))
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c  d e f g "), (3, None), (4, ""), (5, " \t\n"), (None, "x y"),
            (6, long), (7, long + " end"), (8, "x"), (9, "idiot"), (9, "other text of the same id")]
    return [(doc_id, text, "en", None if at % 4 == 0 else f"s{at % 3}", 0, at, "clash") for at, (doc_id, text) in enumerate(rows)]


@pytest.fixture(scope="module")
def odd(spark):
    return stored(spark.createDataFrame(odd_rows(), SCHEMA), "odd")


@pytest.fixture(scope="module")
def empty(spark):
    return stored(spark.createDataFrame([], SCHEMA), "empty")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_components(rows):
    sets = []
    for _, text in rows:
        own = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(own[at:at + 5]) for at in range(len(own) - 4)} if len(own) >= 5 else {tuple(own)} if own else set())
    root = list(range(len(rows)))

    def find(at):
        while root[at] != at:
            at = root[at]
        return at

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for at, (doc_id, _) in enumerate(rows):
        least[find(at)].append(doc_id)
    return sorted((doc_id, len(sets[at]), min(least[find(at)])) for at, (doc_id, _) in enumerate(rows))


def test_near_duplicates_match_brute_force(spark):
    rng, rows = random.Random(4), []
    passage = " ".join(f"p{at}" for at in range(40))
    for group in range(12):
        base = [f"g{group}x{rng.randint(0, 400)}" for _ in range(rng.randint(4, 90))]
        for _ in range(rng.randint(1, 7)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = f"e{rng.randint(0, 999)}"
            rows.append((len(rows) + 1, " ".join(own) + (f" {passage}" if group % 3 == 0 else "")))
    rows += [(900, ""), (901, None), (902, "A b"), (903, "a B"), (904, "a b c d e")]
    told = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((row.doc_id, row.n_shingles, row.component_id) for row in told) == brute_components(rows)
    assert all(row.kept == (row.doc_id == row.component_id) for row in told)


def test_pairs_across_finds_all_links_of_a_key():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[:180 + at % 20], rng.integers(0, 2**63, at % 30, dtype=np.uint64)])) for at in range(40)]
    minima = near_dup.min_hashes(sets)
    short = [np.unique(own.astype("<u2")) for own in sets]
    found = set()
    for left in range(near_dup.COLLECTIONS):
        keys = near_dup.band_keys(minima)[:, left]
        for key in np.unique(keys):
            at = np.flatnonzero(keys == key)
            found |= {(a, b) for a, b, _ in near_dup._pairs_across(
                left, at, at, minima[at].astype("<u2"), [short[one] for one in at])}
    for a in range(40):
        for b in range(a + 1, 40):
            if len(np.intersect1d(sets[a], sets[b])) >= 0.75 * len(np.union1d(sets[a], sets[b])):
                assert (a, b) in found


def test_components_of_paths_and_stars(spark):
    path = [(at, at + 1) for at in range(100, 140)]
    star = [(500, leaf) for leaf in range(1, 20)]
    got = {row.node: row.component for row in components(spark.createDataFrame(path + star + [(7, 7)], "a long, b long")).collect()}
    assert {got[at] for at in range(100, 141)} == {100} and {got[at] for at in [*range(1, 20), 500]} == {1}


def test_exact_dedup_splits_digests_by_full_texts_over_several_batches(spark, odd):
    weak = lambda text: F.substring(F.sha2(text.cast("binary"), 256), 1, 1)
    many = stored(odd.select("doc_id", "text").repartition(4), "many")
    folder = many.inputFiles()[0].rsplit("/", 1)[0]
    stream = exact_dedup.table_stream(spark, folder, many, files=1)
    told = exact_dedup.deduplicate(many, exact_dedup.keyed(stream, weak, exact_dedup.where()), weak).collect()
    groups = defaultdict(list)
    for doc_id, text, *_ in odd_rows():
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id if doc_id is not None else 2**63, doc_id))
    want = sorted(((row[2] or -1), (min(own)[2] or -1), len(own)) for own in groups.values() for row in own)
    assert sorted((row.doc_id or -1, row.keep_id or -1, row.group_size) for row in told) == want


def test_shards_are_exact_and_gapless(spark, odd, empty):
    placed = sharding.shard(odd, 5).collect()
    by_shard = defaultdict(list)
    for row in placed:
        by_shard[row.shard].append(row.slot)
    assert sorted(map(len, by_shard.values())) == [2, 2, 2, 3, 3]
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    assert sharding.shard(empty, 5).count() == 0
    matrix = sharding.communication_matrix([5, 0, 8, 4], 3, 1)
    assert matrix.sum(axis=1).tolist() == [5, 0, 8, 4] and matrix.sum(axis=0).tolist() == [6, 6, 5]


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(at, [float(x) for x in rng.normal(0, 0.2, 16).round(1)]) for at in range(200)]
    rows += [(400, None), (401, [float("nan")] * 16), (402, [None] + [0.1] * 15), (440, rows[0][1]), (None, rows[0][1])]
    table = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk.exact_top_k(table, table.filter("vec_id % 20 = 0"), 5).collect()
    whole = {row.vec_id: row.weights for row in table.collect()}
    want = []
    for query in (vec_id for vec_id in whole if vec_id % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[query], own)), vec_id) for vec_id, own in whole.items() if vec_id != query)
        want += [(query, rank + 1, vec_id, -score) for rank, (score, vec_id) in enumerate(scores[:5])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_mix_comes_near_its_targets(spark, odd, empty):
    rows = [(at, " ".join(["w"] * (1 + at % 9)), "abc"[at % 7 % 3]) for at in range(900)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in "abc":
        own = [row for row in mixed if row.source == source]
        assert abs(sum(row.size * row.copies for row in own) - own[0].target) <= 5
    assert mixing.mix(odd).count() == len(odd_rows()) and mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_packing_keeps_every_id_once_within_all_limits(spark, odd, empty):
    frame = odd.withColumn("skip", F.lit(3))
    pieces = packing.pack(frame, TOKENIZER, tokens=256, segments=3, loss=200, loss_from="skip").collect()
    encoder = Tokenizer.from_file(TOKENIZER)
    want = sorted(tuple([*encoder.encode(text or "", add_special_tokens=False).ids, 1]) for _, text, *_ in odd_rows())
    by_sequence, total = defaultdict(list), 0
    for row in pieces:
        by_sequence[row.sequence_id].append(row)
        total += row.length
        assert len(row.ids) == 4 * row.length
    assert total == sum(map(len, want))
    for own in by_sequence.values():
        own.sort(key=lambda row: row.offset)
        assert len(own) <= 3 and sum(row.length for row in own) <= 256 and sum(row.loss_tokens for row in own) <= 200
        assert [row.offset for row in own] == list(np.cumsum([0] + [row.length for row in own])[:-1])
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_packed_ids_are_the_tokenizers(spark):
    texts = ["end <|endoftext|> of", "<|startoftext|>", "<|ENDOFTEXT|> is text", "plain words", "<|endoftext|><|endoftext|>", "", None]
    encoder = Tokenizer.from_file(TOKENIZER)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(list)
    for row in packing.pack(frame, TOKENIZER).orderBy("doc_id", "start").collect():
        got[row.doc_id] += np.frombuffer(row.ids, "<u4").tolist()
    assert dict(got) == {at: [*encoder.encode(text or "", add_special_tokens=False).ids, 1] for at, text in enumerate(texts)}
    assert 49407 in got[0] and 49406 in got[1]


def test_cached_tokens_equal_the_tokenizer():
    rng = random.Random(2)
    texts = ["", " ", "don't I'LL ''s", "日本 text", "a\x1cb", "½ ² 12a3", "a <|endoftext|> b", "<|STARTOFTEXT|>", "<|endoftext|"] + [
        "".join(rng.choice(" \n\x85\xa0abAB'stdm01²é,.|\x1cßÀ×") for _ in range(rng.randint(1, 50))) for _ in range(800)]
    encoder = tokens.CachedTokenizer(open(TOKENIZER).read())
    assert [ids.tolist() for ids in encoder.encode(texts)] == [
        found.ids for found in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><p>Site</p></header><nav><ul><li><a href=/a>Menu</a>
</ul></nav><div class="cookie-notice">We use cookies.</div><article><h1>Head &amp; line</h1><p title=it's>One <b>bold&nbsp;x</b>
text.<br>More.<p>Two &copy; text, it ends.</p><script>var a="</p>";</script><!-- no --><ul><li>Item one.<li>Item two.</ul></article>
<aside>Side</aside><div class=ad>Buy this now.</div><form><p>Name</p><input></form><section id="comments"><p>Nice post, thank you.</p>
</section><footer>&copy; all rights</footer></body></html>"""


def test_main_text_of_a_page(spark):
    want = "Head & line\nOne bold x text. More.\nTwo © text, it ends.\nItem one.\nItem two."
    assert html_cut.main_text(PAGE, html_cut.PRIOR) == want
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<a " * 20_000), (5, "u", "<p>" * 3000 + "x")],
                                  "page_id long, url string, html string")
    weights = html_cut.fit_blocks(pages)
    got = {row.page_id: row.text for row in pages.select("page_id", html_cut.extracted(F.col("html"), weights).alias("text")).collect()}
    assert got[1] == want and got[2] == got[3] == got[4] == ""


def test_minimum_cut_matches_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        size = rng.randint(1, 7)
        lean = [rng.uniform(-2, 2) for _ in range(size)]
        edges = {(a, b): rng.uniform(0, 2) for a in range(size) for b in range(a) if rng.random() < 0.6}

        def cost(label):
            return -sum(x for x, y in zip(lean, label) if y) + sum(w for (a, b), w in edges.items() if label[a] != label[b])

        best = min(cost([bool(mask >> at & 1) for at in range(size)]) for mask in range(2**size))
        assert abs(cost(html_cut.minimum_cut(lean, edges)) - best) < 1e-6


def brute_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match.group())
            if {"email": True, "ip": kind == "ip" and all(int(part) <= 255 for part in match.group().split(".")),
                    "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, match.start(), match.end()))
    return out


def test_base_spans_match_the_plain_patterns(spark, odd):
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "@", ".", "1", "4111111111111111", " ", "-", "+", "(", "b.c", "255", "12"]) for _ in range(rng.randint(1, 25)))
        assert pii.base_spans(text) == brute_spans(text)
    assert len(pii.base_spans("9" * 200_000 + "a" * 200_000)) == 0
    model = pii.fit_spans(odd)
    assert odd.select(pii.personal_spans(F.col("text"), model).alias("s")).filter(F.size("s") > 0).count() == 0
    one = spark.createDataFrame([("mail a@b.cd now",)], "text string").withColumn("s", pii.personal_spans(F.col("text"), model))
    assert one.select(pii.redacted(F.col("text"), F.col("s"))).first()[0] == "mail [email] now"


def planted_spans(rng):
    """(text, kind, writing, right): loose writings and look-alikes, put between words that training has not seen."""
    name, host = rng.choice(["jane.doe", "k_lund", "bob", "maria.paz"]), rng.choice(["example", "harbour", "north-lab"])
    own = "".join(rng.choice("0123456789") for _ in range(10))
    groups = [own[:3], own[3:6], own[6:]]
    card = "37" + "".join(rng.choice("0123456789") for _ in range(12))
    card += next(d for d in "0123456789" if pii.luhn(card + d))
    wrong = card[:-1] + str((int(card[-1]) + 1) % 10)
    address = [str(rng.randint(20, 255)) for _ in range(4)]
    rows = [
        ("write to", "email", f"{name} (at) {host} (dot) org", True), ("contact", "email", f"{name}[at]{host}[dot]net", True),
        ("lunch", "email", "we @ noon. Then", False), ("call", "phone", f"({groups[0]}) {groups[1]}-{groups[2]}", True),
        ("my phone", "phone", "-".join(groups), True), ("order", "phone", "-".join(groups), False),
        ("since", "phone", f"{rng.randint(1950, 2030)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", False),
        ("paid by card", "card", card, True), ("number", "card", wrong, False), ("host", "ip", " . ".join(address), True),
        ("around", "ip", f"{address[0]} . 900 . {address[1]} . 7", False),
    ]
    return [(f"morning came {before} {writing} and all went on", kind, writing, right) for before, kind, writing, right in rows]


def test_learned_spans_find_loose_writings_and_refuse_look_alikes(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = pii.fit_spans(documents)
    assert set(model.thresholds) == set(pii.KINDS)
    rng = random.Random(11)
    planted = [row for _ in range(40) for row in planted_spans(rng)]
    told = collections.Counter()
    for text, kind, writing, right in planted:
        assert not pii.base_spans(text)
        found = [span for span in pii.spans_of(text, model) if span[1] < text.index(writing) + len(writing) and span[2] > text.index(writing)]
        told[right, any(span[0] == kind and writing in text[span[1]:span[2]] for span in found) if right else bool(found)] += 1
    assert told[True, True] > 0.9 * (told[True, True] + told[True, False]), told
    assert told[True, True] > 0.95 * (told[True, True] + told[False, True]), told
    for text in ("call a@b.cd or +1 (325) 555-8094", "", "no. 12"):
        spans = pii.spans_of(text, model)
        assert [span[:3] for span in spans if span[3]] == pii.base_spans(text)


def test_pii_learns_from_nothing_but_what_base_formats_miss():
    rng = random.Random(2)
    for kind, span in (("email", "a.b@c.de"), ("ip", "1.2.3.44"), ("card", "4111111111111111"), ("phone", "+1 (325) 555-8094")):
        assert pii.base_spans(span) == [(kind, 0, len(span))]
        labels = collections.Counter(right for _ in range(50) for _, _, right in pii.rewritings(kind, span, rng, ["some", "words"]))
        assert labels[True] and labels[False]
        rows = list(pii.training_rows(f"so {span} it is"))
        assert {right for _, right in rows} == {True, False} and rows == list(pii.training_rows(f"so {span} it is"))
    assert list(pii.training_rows("")) == [] == list(pii.training_rows("plain words"))
    assert [right for _, right in pii.training_rows("the 5927243074273351 so")] == [False]
    assert list(pii.training_rows("visa 5927243074273351 so")) == []


def test_classifiers_on_held_out_and_odd_rows(spark, odd, empty):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    model = quality.fit_quality(documents, labels)
    scored = documents.join(labels, "doc_id").filter(quality.is_held_out()).select(
        "quality", quality.quality_score(F.col("text"), model).alias("score")).collect()
    assert np.mean([(row.score >= 0.5) == row.quality for row in scored]) > 0.97
    known, unknown = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    severe = toxicity.fit_severity(documents, known)
    told = documents.join(unknown, "doc_id").select("toxic", toxicity.severity(F.col("text"), severe)["p_toxic"].alias("p")).collect()
    assert np.mean([(row.p >= 0.5) == row.toxic for row in told]) > 0.9
    assert not any(row.p >= 0.5 for row in told if not row.toxic)
    none = labels.filter("false")
    for frame in (odd, empty):
        assert frame.select(quality.quality_score(F.col("text"), model)).count() == frame.count()
        assert toxicity.reject_toxic(frame, toxicity.fit_severity(frame, none)).count() == frame.count()
        assert quality.fit_quality(frame, none) is None


@pytest.mark.parametrize("name", ["odd", "empty"])
def test_pipeline_stages_on_odd_tables(spark, request, name):
    docs = request.getfixturevalue(name)
    columns = docs.columns
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, SF), "stage")
        if at < 4:
            assert docs.columns == columns
        if at == 1 and name == "odd":
            texts = [re.sub(r"[\x20\x09-\x0D]", "", row.text or "") for row in docs.collect()]
            assert len(texts) == len(set(texts))
    assert {row.ids is not None for row in docs.collect()} <= {True}


def test_covered_stretches_match_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        spans = [(at, at + rng.randint(1, 6)) for at in (rng.randint(0, 40) for _ in range(rng.randint(0, 8)))]
        covered = pii.Covered(spans)
        for _ in range(20):
            start = rng.randint(0, 45)
            end = start + rng.randint(1, 6)
            assert covered.meets(start, end) == any(s < end and start < e for s, e in spans)
            if not covered.meets(start, end):
                covered.add(start, end)
                spans.append((start, end))


def test_draws_follow_the_share_however_small(spark):
    keys = spark.range(200_000).withColumn("none", F.lit(None).cast("long"))
    assert 800 < keys.filter(drawn(F.col("id"), 0.005)).count() < 1200
    assert keys.filter(drawn(F.col("id"), 2.0)).count() == 200_000
    assert keys.filter(drawn(F.col("none"), 1.0)).count() == 0


def near_survivors(rows):
    """One (id, text) of each component of rows: the smallest id, a missing one last, then the smallest digest; wordless rows stay."""
    sets = []
    for _, text in rows:
        own = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(own[at:at + 5]) for at in range(len(own) - 4)} if len(own) >= 5 else {tuple(own)} if own else set())
    of = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                of = [of[b] if at == of[a] else at for at in of]
    by_component = defaultdict(list)
    for at, (doc_id, text) in enumerate(rows):
        by_component[of[at]].append((doc_id is None, doc_id or 0, hashlib.sha256((text or "").encode()).hexdigest(), doc_id, text))
    return sorted((min(own)[3:] for own in by_component.values()), key=repr)


def near_copy_rows():
    """Near copies among missing and repeated ids, each beside a clean row of the same id."""
    text = lambda name: [f"{name}{at}" for at in range(40)]
    near = lambda name, end: " ".join([*text(name)[:-1], end])
    return [(1, near("a", "x")), (None, near("a", "y")), (None, near("b", "x")),  # a missing id of a near copy and of a clean row
            (3, near("c", "x")), (5, near("c", "y")), (5, near("d", "x")),  # an id of a near copy and of a clean row
            (7, near("e", "x")), (7, near("e", "y")), (None, near("f", "x")), (None, near("f", "y")),  # near copies of one id
            (9, near("g", "x")), (9, near("g", "y")), (8, near("g", "z")), (10, "h i j"), (None, ""), (11, None)]


def test_near_copies_are_dropped_by_row(spark):
    plain = near_copy_rows()
    again = [*plain, plain[6], plain[7], plain[8], plain[9], plain[2]]  # rows told twice, of which one stays
    for rows in (plain, again):
        docs = stored(spark.createDataFrame(
            [(at % 3, doc_id, text) for at, (doc_id, text) in enumerate(rows)], "source int, doc_id long, text string"), "docs")
        left = corpus_pipeline.drop_near_copies(spark, docs, SF)
        assert left.columns == docs.columns
        assert sorted(((row.doc_id, row.text) for row in left.collect()), key=repr) == near_survivors(rows)


def test_pipeline_run_keeps_one_document_of_each_near_copy_group(spark, tmp_path, monkeypatch):
    rows = near_copy_rows()
    rows += [rows[0], rows[4]]
    spark.createDataFrame([(doc_id, text, "en", "s", 0) for doc_id, text in rows],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    reached = {}

    def seen(frame, name):
        reached[name] = stored(frame, name)
        return reached[name]

    monkeypatch.setattr(corpus_pipeline, "stored", seen)
    corpus_pipeline.run(spark, str(tmp_path)).collect()
    distinct = [row for row in dict.fromkeys(rows) if row != (None, "")]  # exact dedup leaves the empty text with the id
    got = [(row.doc_id, row.text) for row in reached["near_dedup"].collect()]
    assert sorted(got, key=repr) == near_survivors(distinct)


def test_large_components_take_part_in_the_search(spark):
    rows = [(20, [6e7, 1.0]), (21, [1.0, 2.0]), (40, [-3e7, 0.5]), (7, [2.0, 0.0])]
    quantised = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(row.query_id, row.vec_id): row.score for row in topk.exact_top_k(quantised, quantised.filter("vec_id % 20 = 0")).collect()}
    whole = {vec_id: [int(np.floor(64 * x)) for x in vector] for vec_id, vector in rows}
    assert got == {(a, b): sum(x * y for x, y in zip(whole[a], whole[b])) for a in (20, 40) for b in whole if a != b}
