from conftest_llm import prose

from foliospark.llm import templates

QUESTION = (
    "On Monday Tom walks 12 km to the market and then Tom buys 3 baskets of apples for 7 dollars each, "
    "how many dollars does Tom spend if he buys 3 more baskets?"
)
SCHEMA = "doc_id long, text string, item_id string, key string, shift int, slots int"


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x", "k", 1, 2) for i, t in enumerate(texts)], SCHEMA)


def test_questions_with_other_values_are_caught_if_consistent(spark):
    other = QUESTION.replace("Tom", "Ann").replace("12", "40").replace("3", "5").replace("km", "miles").replace("7", "9")
    mixed = QUESTION.replace("Tom walks", "Ann walks").replace("Tom buys", "Bob buys").replace("Tom spend", "Eve spend").replace("3 more", "8 more")
    texts = [f"{prose(1, 40)}. {QUESTION} {prose(2, 30)}", f"{prose(3, 40)}. {other} {prose(4, 10)}", prose(5, 90), f"{prose(6, 9)}. {mixed}", QUESTION.lower()]
    bench = spark.createDataFrame([(7, QUESTION), (8, prose(9, 40)), (9, None), (10, ""), (7, QUESTION)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in templates.contaminated(rows(spark, texts), bench).collect()}
    assert {k for k in found} == {(0, 7), (1, 7), (4, 7)}  # in lower case there are no names, but other windows match
    assert found[0, 7].changed_slots == 0 and found[1, 7].changed_slots > 0
    assert found[1, 7].consistent_slots == found[1, 7].n_slots
    assert sorted(r.doc_id for r in templates.clean(rows(spark, texts), bench).collect()) == [2, 3]


def test_windows_match_a_plain_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in templates.contaminated(docs, bench).collect()}
    strip = lambda t: [templates.EDGES.sub("", w).lower() for w in t.split()]
    expected = set()
    for b in bench.collect():
        item = strip(b.text)
        for d in docs.collect():
            text = strip(d.text)
            at = [i for i in range(len(text)) if text[i : i + len(item) - 2] == item[1:-1]]
            if at:
                expected.add((d.doc_id, b.item_id))
    assert expected and found >= expected
    assert len(found - expected) <= 2


def test_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, prose(4, 30)), (2, "x"), (3, None)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in templates.contaminated(odd, bench).collect()}
    assert found == {(1, 1), (8, 2)}
    left = templates.clean(odd, bench)
    assert left.columns == odd.columns and left.count() == odd.count() - 2
    assert templates.contaminated(empty, bench).count() == templates.clean(empty, bench).count() == 0
    assert templates.clean(odd, bench.limit(0)).count() == odd.count()


def caught(spark, texts, items):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in templates.contaminated(rows(spark, texts), bench).collect()}


def test_short_items_are_found_inside_longer_texts(spark):
    items = ["What is the capital of France?", "Name three large rivers", prose(9, 40)]
    texts = [f"{prose(1, 40)}. {items[0]} {prose(2, 30)}", f"{prose(3, 30)} {items[1]} {prose(4, 9)}", items[0], prose(5, 60), "What is"]
    assert caught(spark, texts, items) == {(0, 0), (2, 0), (1, 1)}


def test_items_poor_in_literals_are_found_verbatim(spark):
    items = [
        "Die Frau Müller kauft im Supermarkt Äpfel, Birnen, Orangen, Bananen, Milch, Butter, Brot und Käse für 12 Euro.",
        "Which of Paris, London, Berlin, Madrid, Rome, Vienna, Warsaw, Lisbon, Dublin, Oslo and Athens lies furthest north?",
    ]
    texts = [f"{prose(1, 40)}. {items[0]} {prose(2, 30)}", f"{prose(3, 30)} {items[1]} {prose(4, 9)}", items[1]]
    texts += [items[0].replace("Birnen", "Pflaumen").replace("Milch", "Sahne").replace("Käse", "Quark").replace("Orangen", "Feigen"), prose(5, 60)]
    assert caught(spark, texts, items) == {(0, 0), (1, 1), (2, 1)}


def test_names_that_open_sentences_are_slots(spark):
    item = "Anna has 5 apples. Anna gives 3 to Ben. Anna then buys 4 more apples. Ben eats 2 of his apples at home. Anna counts what is left."
    other = item.replace("Anna", "Maria").replace("Ben", "Tom").replace("5", "9").replace("4", "7")
    mixed = item.replace("Anna has", "Maria has").replace("Anna gives", "Tom gives").replace("Anna then", "Eve then")
    mixed = mixed.replace("Ben eats", "Paul eats").replace("Anna counts", "Kim counts").replace("to Ben", "to Sue")
    texts = [f"{prose(1, 40)}. {other} {prose(2, 30)}", f"{prose(3, 40)}. {mixed}", prose(5, 60), item]
    assert caught(spark, texts, [item]) == {(0, 0), (3, 0)}


def test_one_repeated_fragment_convicts_nothing(spark):
    item = prose(9, 20)
    words = item.split()
    fragment, start = " ".join(words[4:12]), " ".join(words[:14])
    texts = [f"{fragment} {prose(1, 30)} " * 6, f"{fragment} " * 6, f"{prose(1, 9)} {start} {prose(2, 30)}", f"{prose(3, 9)} {' '.join(words[:10])} inserted {' '.join(words[10:])}"]
    assert caught(spark, texts, [item]) == {(2, 0), (3, 0)}


def test_quick_properties_of_words_are_those_of_the_patterns():
    signs = ["", ".", ",", "!", "?", ":", ";", '"', ")", "..", '."', "%", "-"]
    for core in ["word", "Word", "WORD", "w", "W", "seven", "Seven", "km", "KM", "Km", "12", "12km", "é", "Élan", "x2", "a-b"]:
        for word in [sign + core + end for sign in ["", "(", "$"] for end in signs]:
            data = word.encode()
            stripped = templates.EDGES.sub("", word)
            low = stripped.lower()
            if templates.NUMBER.fullmatch(low) or low in templates.NUMBER_WORDS:
                kind = 1
            elif low in templates.UNITS:
                kind = 2
            else:
                kind = 3 if len(stripped) > 1 and stripped[0].isupper() and stripped[1:].islower() else 0
            ends = word[-1] in ".!?:" or word[-2:-1] in (".", "!", "?")
            assert templates.properties(data) == (templates.xxhash.xxh64_intdigest(low.encode()), kind, ends), word


def test_words_are_taken_over_when_the_table_is_full(monkeypatch):
    monkeypatch.setattr(templates, "CACHE", 20)
    texts = [prose(seed, 30).encode() for seed in range(12)]
    short = templates.Canonical()
    for text in texts + texts:
        for mine, whole in zip(short.tokens(text)[:3], templates.Canonical().tokens(text)[:3]):
            assert mine.tolist() == whole.tolist()
