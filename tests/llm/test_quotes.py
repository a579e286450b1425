import random

import duckdb

from millrace.llm.quotes import link_quotes, oracle, order_replies

SCHEMA = "conv_id long, turn long, role string, text string"
A = "The release is planned for Friday."
B = "I would rather wait until Monday, since the tests are slow.\nThe build machine is also busy."
ROWS = [
    (1, 0, "user", A),
    (1, 1, "user", B),
    (1, 2, "user", f"On Tue, Ann wrote:\n> {A.upper()}\n\nFriday is fine."),
    (1, 3, "user", "> On Wed, Bob wrote:\n>> The release   is planned for Friday.\n> \n> Friday is fine.\nThen let us do it."),
    (1, 4, "user", "> The build machine is also busy.\nNot any more."),
    (2, 0, "user", f"> {A}\nSeen in the other thread."),
    (2, 1, "user", "> nobody ever said this sentence\nWho said so?"),
    (3, 0, "user", None),
    (3, 1, "user", "a > b and b > c"),
    (3, 2, "user", ""),
]


def test_links_and_order(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    links = sorted((r.conv_id, r.turn, r.level, r.source_conv, r.source_turn) for r in link_quotes(df).where("source_conv is not null").collect())
    assert links == [(1, 2, 1, 1, 0), (1, 3, 1, 1, 2), (1, 3, 2, 1, 0), (1, 4, 1, 1, 1), (2, 0, 1, 1, 0)]
    out = order_replies(df).collect()
    assert [(r.conv_id, r.turn) for r in out] == [(1, 0), (1, 2), (1, 3), (1, 1), (1, 4), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)]
    by = {(r.conv_id, r.turn): r for r in out}
    assert (by[1, 3].parent_turn, by[1, 3].root_turn, by[1, 3].depth) == (2, 0, 2)
    assert by[1, 2].body == "Friday is fine." and by[1, 3].body == "Then let us do it." and by[3, 1].body == "a > b and b > c"
    assert by[1, 1].body == B and by[2, 1].parent_turn is None and by[2, 1].n_quotes == 1 and by[2, 1].n_linked == 0


def test_long_chain_and_copies(spark):
    text = lambda i: f"Message number {i} with its own words."
    rows = [(7, i, "user", (f"> {text(i - 1)}\n" if i else "") + text(i)) for i in range(40)]
    out = {r.turn: r for r in order_replies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all((out[i].depth, out[i].root_turn, out[i].body) == (i, 0, text(i)) for i in range(40))
    twice = order_replies(spark.createDataFrame([*ROWS, *ROWS, (None, None, None, "> x\ny")], SCHEMA)).collect()
    assert len(twice) == 21


def compared(spark, rows):
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    want = sorted(con.execute(oracle()).fetchall(), key=str)
    out = order_replies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.conv_id, r.turn, r.role, r.n_quotes, r.n_linked, r.parent_turn, r.source_conv, r.source_turn, r.root_turn, r.depth, r.body) for r in out), key=str) == want
    return out


def threads(seed, n_threads, n_turns):
    """Threads whose messages quote earlier ones whole, in part, nested, wrapped anew, or from another thread."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("the build test friday release server is was not slow very green fails again maybe later ok".split())
    sentence = lambda: " ".join(word() for _ in range(rnd.randint(2, 9))).capitalize() + rnd.choice(".!?")
    rows, said = [], {}
    for c in range(n_threads):
        for t in range(n_turns):
            own = "\n\n".join(rnd.choice(("\n", " ")).join(sentence() for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(1, 2)))
            quote = ""
            if t and rnd.random() < 0.8:
                other = rnd.choice([k for k in said if k[0] == c] if rnd.random() < 0.9 else list(said))
                source = said[other]
                kind = rnd.randrange(4)
                if kind == 1:
                    source = rnd.choice(source.split("\n"))
                elif kind == 2:
                    source = source.replace(" ", "\n", 3)
                elif kind == 3:
                    source = source[: source.find(".") + 1] or source
                quote = "Ann wrote:\n" * rnd.randrange(2) + "".join(f"> {line}\n" for line in source.split("\n"))
                if rnd.random() < 0.3:
                    quote += "".join(f">> {line}\n" for line in rnd.choice(list(said.values())).split("\n"))
            said[c, t] = own
            rows.append((c, t, "user", quote + own))
    return rows


def test_generated_threads_against_sql(spark):
    out = compared(spark, threads(5, 60, 20))
    assert sum(r.n_linked for r in out) > 800 and max(r.depth for r in out) >= 4


def test_short_lines_and_parts_that_were_wrapped_anew(spark):
    long = "We met on Tuesday and talked at length about the plan. Friday is fine. Someone should still write to the printers about the covers."
    rows = [
        (1, 0, "user", long), (1, 1, "user", "> Friday is fine.\nGood."), (1, 2, "user", "> Someone should still write to the\n> printers about the covers.\nI will."),
        (2, 0, "user", "> Friday is fine.\nWhich Friday?"), (2, 1, "user", "> Someone should still write to the\n> printers about the covers.\nWho?"),
    ]
    links = {(r.conv_id, r.turn): (r.source_conv, r.source_turn) for r in link_quotes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert links == {(1, 1): (1, 0), (1, 2): (1, 0), (2, 0): (None, None), (2, 1): (1, 0)}
    compared(spark, rows)


def test_the_first_other_conversation_is_the_source(spark):
    """The asking conversation holds the text too, later: the least other one is linked, not the last."""
    original = "The quarterly figures will be published tomorrow."
    rows = [(1, 0, "user", f"> {original}\nReally?"), (1, 1, "user", original), (2, 3, "user", original), (2, 5, "user", original), (3, 0, "user", original), (4, 0, "user", original), (5, 0, "user", f"> {original}\nYes.")]
    links = {(r.conv_id, r.turn): (r.source_conv, r.source_turn) for r in link_quotes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert links == {(1, 0): (2, 3), (5, 0): (1, 1)}
    out = {(r.conv_id, r.turn): (r.source_conv, r.source_turn) for r in compared(spark, rows)}
    assert out[1, 0] == (2, 3) and out[5, 0] == (1, 1) and out[2, 3] == (None, None)
    many = [(c, 0, "user", original) for c in range(10, 300)] + [(c, 1, "user", f"> {original}\nSo be it.") for c in range(0, 300, 7)]
    compared(spark, many)


def test_very_long_text_and_clashing_columns(spark):
    text = "A sentence that is said once and quoted later on. " * 4000
    rows = [(1, 0, "user", text, 1, "x"), (1, 1, "user", f"> {text}\nyes", 2, "y")]
    df = spark.createDataFrame(rows, SCHEMA + ", depth int, body string")
    got = {r.turn: r for r in order_replies(df).collect()}
    assert got[1].parent_turn == 0 and got[1].body == "yes" and got[1].depth == 1 and order_replies(df).columns.count("depth") == 1


def test_empty(spark):
    assert order_replies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_oracle(spark):
    compared(spark, ROWS)
