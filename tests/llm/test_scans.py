import pytest

from folio.llm import scans

HEADER = "THE CAMPAIGN IN ZANECY. {}"


@pytest.fixture(scope="module")
def table(spark):
    plain = "the battalion marched with the cavalry and the old treasury was repaired at the bridge. "
    rows = [(f"p{i}", plain * 3, "x") for i in range(8)]
    rows += [
        ("hyphen", "the old trea-\nsury was repaired", "x"),
        ("soft", "the old trea­\nsury was repaired", "x"),
        ("compound", "the rear-guard, the rear-guard and the rear-\nguard of the rear-guard", "x"),
        ("page", "the old treasury\n128\nwas repaired", "x"),
        ("misread", "tlie batta1ion rnarched vvith the cavalry", "x"),
        ("capitals", "THE OLD TREASURY WAS REPAIRED AT THE BRIDGE.\nthe battalion marched", "x"),
        ("wrapped", "the old treasury\nwas repaired", "x"),
        ("null", None, "x"),
        ("blank", "  \n ", "x"),
        ("hyphen", "the old trea-\nsury was repaired", "x"),
    ]
    rows += [(f"head{i}", f"the battalion marched\n{HEADER.format(100 + i)}\nwith the cavalry", "x") for i in range(4)]
    return spark.createDataFrame(rows, "key string, text string, kind string")


def test_kinds(table):
    got = {(r.rec_key, r.kind) for r in scans.kinds(table, "key", "text").collect()}
    want = {("hyphen", "hyphen"), ("soft", "hyphen"), ("page", "furniture"), ("misread", "misread")}
    assert got == want | {(f"head{i}", "furniture") for i in range(4)}


def test_repair(table):
    got = {r.rec_key: r.text for r in scans.restored(table, "key", "text").collect()}
    assert got["hyphen"] == got["soft"] == "the old treasury was repaired"
    assert got["page"] == "the old treasury was repaired"
    assert got["misread"] == "the battalion marched with the cavalry"
    assert got["head1"] == "the battalion marched with the cavalry"
    assert "null" not in got and "blank" not in got


def test_candidates_are_complete():
    v = scans.Vocabulary({"cat": 9, "cart": 9, "coat": 9, "dog": 9, "at": 9})
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]
    for token in ("cat", "ct", "caat", "doq", "xx", "cxat"):
        assert {w for w in v.counts if distance(token, w) <= 2} <= set(v.within(token, 4))


def test_empty(table):
    assert scans.kinds(table.limit(0), "key", "text").count() == 0


def test_context_ranks_every_retrieved_word():
    words = {f"b{c}t": 100 + i for i, c in enumerate("aeiouy")} | {"bet": 1000}
    found = [w for w, _ in scans.Vocabulary(words).misread("b*t", 1)]
    assert {"bat", "bet", "bit", "bot", "but", "byt"} <= set(found)


def test_the_word_after_decides_between_equal_repairs(spark):
    rows = [(f"a{i}", "they saw the bear run away") for i in range(9)] + [(f"b{i}", "they saw the hear say now") for i in range(9)]
    rows += [("x", "they saw the 6ear run away"), ("y", "they saw the bcar say now")]
    got = {r.rec_key: r.text for r in scans.restored(spark.createDataFrame(rows, "key string, text string"), "key", "text").collect()}
    assert got["x"] == "they saw the bear run away" and len(got) == 20


def test_a_long_garbled_token_is_retrieved_too():
    word = "internationalestablishments"
    garbled = word.replace("t", "!", 1).replace("shm", "shrn")
    assert len(garbled) > 24 and [w for w, _ in scans.Vocabulary({word: 50}).misread(garbled[:9] + "x" + garbled[9:], 1)] == [word]


def test_words_below_a_millionth_of_all_are_found(spark):
    rows = [(f"k{i}", f"{i} " + "a " * 800_000) for i in range(4)] + [("w", "harbour " * 3), ("x", "har~our")]
    noise, _ = scans.assess(spark.createDataFrame(rows, "key string, text string"), "key", "text")
    assert {(r.token, r.repair) for r in noise.where("kind = 'misread'").collect()} == {("har~our", "harbour")}


def test_a_vocabulary_in_blocks_gives_the_same(spark, table):
    hard = [("long", "the old batta1i0nx marched vvith trea­\nsury and zq!zqq rear-\nguard"), ("bare", "'battalion! «the»")]
    df = table.unionByName(spark.createDataFrame([(*r, "x") for r in hard], table.schema))
    for rank in (True, False):
        whole, _ = scans.assess(df, "key", "text", rank)
        blocks, _ = scans.assess(df, "key", "text", rank, block_words=4)
        want = sorted(tuple(r) for r in whole.collect())
        assert want and sorted(tuple(r) for r in blocks.collect()) == want
