import pytest

from weftgraph.plans.lexer import QueryError
from weftgraph.streaming.follower import Config, FollowerStore, Permanent, Schema, StoreError, Transient


class Recorder:
    def __init__(self, fail=()):
        self.seen, self.fail, self.flushed = [], list(fail), 0

    def connect(self):
        pass

    def apply(self, mutation):
        if self.fail:
            e = self.fail.pop(0)
            if e:
                raise e
        self.seen.append((mutation["local_seq"], mutation["op"]))

    def flush(self):
        self.flushed += 1


@pytest.fixture
def store(spark, tmp_path):
    s = FollowerStore(spark, str(tmp_path / "store"))
    s.insert_nodes([("a", "Person", {"name": "Ann", "age": 3}), ("b", "Person", {"name": "Bob"}), ("c", "City", {"name": "Cork"})])
    s.insert_edge("e1", "KNOWS", "a", "b", since=2020)
    return s


def test_changes_are_checked(store):
    with pytest.raises(StoreError):
        store.insert_node("a", "Person")
    with pytest.raises(StoreError):
        store.insert_edge("e2", "KNOWS", "a", "nobody")
    store.insert_node("e1", "Person")  # ids of nodes and edges are apart
    assert store.has_node("e1") and store.has_edge("e1")
    assert store.get_node("a") == {"id": "a", "label": "Person", "properties": {"age": 3, "name": "Ann"}}
    assert store.get_edge("e1")["to"] == "b"


def test_queries(store):
    rows = store.query("MATCH (n:Person)-[k:KNOWS]->(m) WHERE id(n) = 'a' RETURN n.name, m.name, k.since").collect()
    assert [tuple(r) for r in rows] == [("Ann", "Bob", 2020)]
    assert store.query("MATCH (n:Person) WHERE n.age = NULL RETURN id(n)").collect()[0][0] == "b"  # equality with NULL is true or false
    assert store.query("MATCH (n:Person) WHERE n.nothing IS NULL RETURN count(*)").first()[0] == 2
    assert store.query("MATCH (n:Person) WHERE n.name != 'Ann' RETURN n.name").first()[0] == "Bob"
    assert store.query("MATCH (n:Person) RETURN collect(n.age)").first()[0].count(None) == 1
    assert store.query("MATCH (n:Person) WHERE id(n) = $x RETURN n._meta.foreshadow, n._meta.nothing", {"x": "a"}).first()[0] is False


def test_create_merge_delete(store):
    store.query("CREATE (p:Person {id: 'z', name: 'Zoe'})")
    store.query("MERGE (p:Person {id: 'z', name: 'other'})")
    assert store.get_node("z")["properties"] == {"name": "Zoe"}
    store.query("CREATE ({id: 'z'})-[:KNOWS {id: 'e9'}]->({id: 'a'})")
    assert store.has_edge("e9")
    with pytest.raises(QueryError, match="DeleteEdgeUnsupported"):
        store.query("MATCH (a)-[e:KNOWS]->(b) DELETE e")
    store.query("MATCH (n:Person) WHERE id(n) = 'b' DELETE n")
    assert not store.has_node("b") and store.has_edge("e1")  # a plain delete leaves the edge
    assert store.delete_node_with_cascade("a") == 2
    assert store.edges().count() == 0


def test_schema(store):
    assert store.apply_schema(Schema(2, {"Person": {"age": "I64"}}, {"KNOWS": {}}))
    assert not store.apply_schema(Schema(1))
    with pytest.raises(StoreError):
        store.insert_node("q", "Dog")
    with pytest.raises(StoreError):
        store.insert_node("q", "Person", age="old")
    store.insert_node("q", "Person", age=None, more=[1, "x"])
    again = FollowerStore(store.spark, store.path)
    assert again.schema.version == 2 and again.seq == store.seq


def test_sync_in_order_with_retries(store, tmp_path):
    waits = []
    r = Recorder([Transient(), Transient(), None, Permanent()])
    store.sync(r, str(tmp_path / "ck"), waits.append)
    assert waits == [0.1, 0.2] and [s for s, _ in r.seen] == [1, 3, 4] and r.flushed == 1
    store.delete_edge("e1")
    store.sync(r, str(tmp_path / "ck"), waits.append)
    assert r.seen[-1] == (5, "EdgeDelete") and len(r.seen) == 4


def test_foreshadow_and_torn_tail(store, tmp_path):
    store.insert_node("f", "Person", foreshadow=True)
    r = Recorder()
    assert store.replay_unconfirmed(r) == 1 and r.seen == [(5, "NodeInsert")]
    with open(f"{store.path}/log/part-torn.json", "w") as f:
        f.write('{"local_seq": 99, "op": "NodeIns')
    assert FollowerStore(store.spark, store.path).seq == 5


def test_config():
    c = Config.from_toml('[identity]\nuser = "u"\n[capability]\ncan_write = false\n')
    assert c.user == "u" and not c.can_write
    with pytest.raises(StoreError):
        Config.from_toml("x = 1")
