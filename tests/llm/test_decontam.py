from emberwatch.llm.decontam import clean_documents, contaminated

ITEM = "A train leaves Paris at 60 km per hour. After 3 hours Alice asks how far the train has gone from the old station near the river."
OTHER = ITEM.replace("Paris", "Berlin").replace("60", "75").replace("3", "5").replace("Alice", "Robert")
MIXED = ("A train leaves Paris at 60 km per hour and a car leaves Paris at 60 km per hour while Paris sleeps and the people "
         "of Paris watch how Paris and its 60 bridges shine in the calm and silent night of a long summer.")
PROSE = "Quite another text about the weather in the hills where nobody asks anything and the birds sing all day long without end."


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, raw string, h int, size int")


def items(spark, texts):
    return spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)], "item_id long, text string, tok string")


def found(df):
    return {(r.doc_id, r.item_id): r for r in df.collect()}


def test_exact_reparameterised_and_clean(spark):
    texts = [f"{PROSE} {ITEM} {PROSE}", f"{PROSE}\n{OTHER}", PROSE, None, "", ITEM.upper(), f"{PROSE} {' '.join(ITEM.split()[:9])} {PROSE}",
             ("filler words here " * 20000) + ITEM, ITEM, ITEM]
    got = found(contaminated(docs(spark, texts), items(spark, [ITEM, "too short", None])))
    assert set(got) >= {(0, 0), (1, 0), (7, 0), (8, 0), (9, 0)} and not {i for i, _ in got} & {2, 3, 4, 6}
    assert got[0, 0].n_changed == 0 and got[1, 0].n_changed > 0 and got[1, 0].n_consistent == got[1, 0].n_slots
    kept = clean_documents(docs(spark, texts), items(spark, [ITEM]))
    assert kept.columns == ["doc_id", "text", "raw", "h", "size"]
    assert {2, 3, 4, 6} <= {r.doc_id for r in kept.collect()} and not {0, 1, 7, 8, 9} & {r.doc_id for r in kept.collect()}


def test_inconsistent_slots_are_no_match(spark):
    names = iter(["Rome", "Oslo", "Bern", "Kiew", "Riga", "Wien"])
    numbers = iter(["11", "22", "33"])
    scrambled = " ".join(next(names) if w == "Paris" else next(numbers) if w == "60" else w for w in MIXED.split())
    swapped = MIXED.replace("Paris", "Rome").replace("60", "99")
    got = found(contaminated(docs(spark, [MIXED, swapped, scrambled]), items(spark, [MIXED])))
    assert set(got) == {(0, 0), (1, 0)} and (got[1, 0].n_slots, got[1, 0].n_changed) == (3, 3)  # a number and its unit are one value


def test_short_items_and_shared_windows(spark):
    short = "seven plain words make this item"                     # six tokens: one window of its own size
    texts = [f"{PROSE} {short} {PROSE}", "seven plain words make this", f"{ITEM} and {short}"]
    got = found(contaminated(docs(spark, texts), items(spark, [short, ITEM, ITEM])))
    assert set(got) == {(0, 0), (2, 0), (2, 1), (2, 2)}


def test_tables_without_rows(spark, edge_docs, no_docs):
    one = items(spark, [ITEM])
    assert contaminated(no_docs, one).count() == 0
    assert contaminated(edge_docs, one.limit(0)).count() == 0
    assert clean_documents(edge_docs, one).count() == edge_docs.count()
    assert clean_documents(edge_docs, one.limit(0)).count() == edge_docs.count()


def test_verbatim_items_of_few_plain_words(spark):
    few = ["Compute 12 + 30 - 7 * 4 and round to 2 digits.", "What is 48 + 17 * 3?", "Who wrote Hamlet?", "法国的首都是哪座城市",
           "1 2 3 4 5 6 7 8 9 10 11 12 and so on until you reach 20", "km or mile is longer here"]
    texts = [f"{PROSE} {t} {PROSE}" for t in few] + ["有人问法国的首都是哪座城市吗", "It took 7 km or mile is longer here", PROSE, "Who wrote it?"]
    got = found(contaminated(docs(spark, texts), items(spark, [*few, "?!", ""])))
    assert set(got) == {(i, i) for i in range(len(few))} | {(6, 3), (7, 5)}
    assert all(r.n_changed == 0 for r in got.values())
    assert {r.covered for (_, i), r in got.items() if i == 4} == {19}      # the half of numbers counts too


ALICE = "Alice has 3 apples. Bob has 5 apples. Carol eats 2 apples. Who has the fewest?"
FRANCE = "What is the capital city of France?"
LONG = ("Anna walks from Paris to the old mill by the river every morning with a basket of bread and then "
        "gives half of it to Peter who lives near the bridge")


def test_cases_that_one_diagonal_or_sentence_starts_would_hide(spark):
    swapped = ALICE.replace("Alice", "Dora").replace("Bob", "Emil").replace("Carol", "Frieda").replace("3", "7").replace("5", "9")
    longer = LONG.replace("Anna", "Mary Ann Smith").replace("Paris", "San Francisco").replace("Peter", "Jean Luc")
    words = LONG.split()
    inserted = " ".join(words[:10] + "one two three four five".split() + words[10:20] + "six seven eight nine ten".split() + words[20:])
    texts = [f"{PROSE} {swapped} {PROSE}", f'{PROSE} so - "{FRANCE}" {PROSE}', f"{PROSE} {longer} {PROSE}", f"{PROSE} {inserted} {PROSE}",
             f"{PROSE} {FRANCE.upper()}", f"{PROSE} {LONG.lower()}", PROSE, "It costs $5 or 60 km. " + PROSE]
    got = found(contaminated(docs(spark, texts), items(spark, [ALICE, FRANCE, LONG])))
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 2), (4, 1), (5, 2)}
    assert got[0, 0].n_changed > 0 and not got[0, 0].literal and got[1, 1].literal and got[2, 2].n_changed == 3


def test_units_and_numbers_are_one_value(spark):
    item = "A pump fills a tank of 60 litres in 4 hours for $12 and runs the whole night long"
    other = "A pump fills a tank of 700 in 9 min for €3.50 and runs the whole night long"
    got = found(contaminated(docs(spark, [f"{PROSE} {other}"]), items(spark, [item])))
    assert (got[0, 0].n_slots, got[0, 0].n_changed) == (3, 3)


def test_very_short_items_must_be_the_whole_document(spark):
    texts = ["yes", "Yes.", f"{PROSE} yes {PROSE}", "yes yes", "42 km", "run 42 km today"]
    assert set(found(contaminated(docs(spark, texts), items(spark, ["Yes", "42 km"])))) == {(0, 0), (1, 0), (4, 1)}


def test_a_long_run_of_a_longer_item_counts(spark):
    item = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    part = " ".join(item.split()[100:180])
    got = found(contaminated(docs(spark, [f"{PROSE} {part} {PROSE}", " ".join(item.split()[:40])]), items(spark, [item])))
    assert set(got) == {(0, 0)} and got[0, 0].covered == 80


def test_twin_on_all_kinds_of_items(spark, tmp_path):
    import duckdb
    from emberwatch.llm.decontam import ORACLE, op2

    items_ = [ITEM, MIXED, ALICE, FRANCE, LONG, "Who wrote Hamlet?", "yes", "法国的首都是哪座城市", "What is 48 + 17 * 3?"]
    texts = [None, "", f"{PROSE} {ITEM}", OTHER, ALICE.replace("Bob", "Jim Beam"), f'so - "{FRANCE}"', f"{LONG.lower()} {PROSE}", "who wrote hamlet",
             f"x Who wrote Hamlet? {PROSE}", "yes", "oh yes", "有人问abc法国的首都是哪座城市吗", "What is 48 + 17 * 3?", f"{MIXED} {MIXED}", PROSE]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items_)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = op2(spark, str(tmp_path))
    want = con.sql(ORACLE)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.project(", ".join(got.columns)).fetchall()) and got.count() >= 10


def test_windows_are_hashed_only_where_all_tokens_are_known(spark):
    from pyspark.sql import functions as F

    from emberwatch.llm.decontam import bit_table, places, starts_of

    known = spark.createDataFrame([(h,) for h in (101, 202, 303)], "h long")
    rows = spark.createDataFrame([([7, 101, 202, 303, 8, 202, 101],), ([],), ([9],)], "codes array<long>")
    got = rows.select(places("codes", bit_table(known.select(F.xxhash64("h").alias("h")))).alias("none"),
                      places("codes", bit_table(known)).alias("spots")).withColumn("two", starts_of("spots", 2)).withColumn("three", starts_of("spots", 3))
    assert [(r.none, r.spots, r.two, r.three) for r in got.collect()] == [([], [1, 2, 3, 5, 6], [1, 2, 5], [1]), ([], [], [], []), ([], [], [], [])]


def test_bit_tables_stand_once_and_lose_nothing(spark):
    from pyspark.sql import functions as F

    from emberwatch.llm.decontam import PROBES, bit_table, maybe, places

    assert str(maybe(F.col("h"), F.col("bits"))).count("bits") == 1 and str(places("codes", F.col("bits"))).count("bits") == 1
    known = spark.range(500).select(F.xxhash64("id").alias("h"))
    codes = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.xxhash64(i.cast("long"))).alias("codes"))
    for probes in (1, PROBES):
        spots = codes.select(places("codes", bit_table(known, probes)).alias("x")).first().x
        assert spots[:500] == list(range(500)) and len(spots) < 520
    assert known.where(maybe(F.col("h"), bit_table(known))).count() == 500
