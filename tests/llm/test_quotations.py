import random

from eventmill.llm import quotations

SCHEMA = "conv_id long, turn long, role string, text string, place int, thread string"


def run(spark, rows):
    messages = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return quotations.conversations(messages).collect()


def test_nested_quotes_link_to_their_messages(spark):
    rows = [
        (1, 0, "user", "Hello there my friend.\nHow are you doing today?"),
        (1, 1, "assistant", "I am fine, thanks a lot.\n\nThe weather is nice here."),
        (1, 2, "user", "On Monday X wrote:\n> I am fine, thanks a LOT.\n>\n>> Hello there my friend.\n>> How are you doing today?\nGreat to hear that."),
        (1, 3, "assistant", "> > I am fine, thanks a lot.\n> Great to hear that.\nIndeed so."),
        (1, 4, "user", "> How are you\n> doing today?\nNot bad."),
        (1, 5, "user", "> Hello there my friend.\n> [some lines left out]\nHi!"),
        (1, 6, "user", "Not a quote > at all"),
        (2, 0, "user", "> Hello there my friend.\nok"),
    ]
    found = {(r.conv_id, r.turn): r for r in run(spark, rows)}
    assert found[1, 2].text == "Great to hear that." and (found[1, 2].n_quotes, found[1, 2].n_linked) == (2, 2)
    assert (found[1, 2].reply_to, found[1, 2].thread, found[1, 2].depth) == (1, 1, 1)
    assert (found[1, 3].text, found[1, 3].reply_to, found[1, 3].thread, found[1, 3].depth) == ("Indeed so.", 2, 1, 2)
    # Re-wrapped text is found as a whole only where lines join alike; here it is the paragraph's tail.
    assert found[1, 5].reply_to == 0 and found[1, 5].text == "Hi!"
    assert found[1, 6].text == "Not a quote > at all" and found[1, 6].n_quotes == 0
    assert found[2, 0].reply_to is None and found[2, 0].n_quotes == 1 and found[2, 0].n_linked == 0
    order = [r.turn for r in sorted((r for r in found.values() if r.conv_id == 1), key=lambda r: r.place)]
    assert order.index(0) < order.index(5) < order.index(1) < order.index(2) < order.index(3)
    assert sorted(r.place for r in found.values() if r.conv_id == 1) == list(range(7))


def test_long_reply_chains_and_hot_conversations(spark):
    rows = [(1, 0, "user", "message number zero says this")]
    rows += [(1, i, "user", f"> message number {i - 1 if i > 1 else 'zero'} says this\nmessage number {i} says this") for i in range(1, 70)]
    rows += [(1, 100 + i, "user", "message number zero says this") for i in range(50)]
    found = {r.turn: r for r in run(spark, rows)}
    assert all((found[i].depth, found[i].thread, found[i].reply_to) == (i, 0, i - 1) for i in range(1, 70))
    assert [found[i].place for i in range(70)] == list(range(70))


def test_replies_follow_what_they_reply_to(spark):
    """Random threads against a plain walk; one turn has many replies, one chain is long."""
    draw, rows, ups = random.Random(5), [], {}
    for conv in range(4):
        for turn in range(120):
            up = None if turn == 0 or draw.random() < 0.1 else (3 if draw.random() < 0.3 else draw.randrange(turn))
            if up is not None and up >= turn:
                up = turn - 1
            if conv == 3:
                up = turn - 1 if turn else None
            ups[conv, turn] = up
            quote = "" if up is None else f"> these are words of message {up} in {conv}\n"
            rows.append((conv, turn, "user", f"{quote}these are words of message {turn} in {conv}"))
    rows.append((0, 3, "user", rows[3][3]))  # a row twice
    found = run(spark, rows)
    for conv in range(4):
        kids = {}
        for turn in range(120):
            kids.setdefault(ups[conv, turn], []).append(turn)
        want, todo = [], list(reversed(kids[None]))
        while todo:
            turn = todo.pop()
            want += [turn] * (2 if (conv, turn) == (0, 3) else 1)
            todo += reversed(kids.get(turn, []))
        assert [r.turn for r in sorted((r for r in found if r.conv_id == conv), key=lambda r: r.place)] == want


def test_deep_levels_and_carriage_returns(spark):
    rows = [(1, 0, "a", "the deepest words of all"), (1, 1, "b", ">" * 12 + " the deepest words of all\r\n\r\nmy own\r\n")]
    found = {r.turn: r for r in run(spark, rows)}
    assert found[1].n_linked == 1 and found[1].reply_to is None and found[1].text == "my own"


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "a", "> x y z"), (1, None, "a", "> hello you there"), (1, 0, "a", "hello you there"), (1, 0, "a", "hello you there"), (2, 0, "a", "")]
    found = run(spark, rows)
    assert len(found) == 6 and all(r.reply_to is None for r in found)
    assert sorted(r.place for r in found if r.conv_id == 1) == [0, 1, 2]
    assert run(spark, []) == []
