"""Reading extracts, assembling areas, and the way from a file to hits."""

from __future__ import annotations

import pytest

from waymark import cli
from waymark.operators import ingest
from waymark.sources import osm

NODES = {1: (23.0, 48.0), 2: (24.0, 48.0), 3: (24.0, 49.0), 4: (23.0, 49.0), 5: (23.4, 48.4), 6: (23.6, 48.4), 7: (23.6, 48.6), 8: (23.4, 48.6)}
EXTRACT = (
    "<osm>"
    + "".join(f'<node id="{k}" lat="{y}" lon="{x}"/>' for k, (x, y) in NODES.items())
    + """<node id="20" lat="48.3" lon="23.3"><tag k="name" v="Славсько"/><tag k="place" v="town"/></node>
<node id="21" lat="48.301" lon="23.301"><tag k="name" v="Медовий  двір"/><tag k="tourism" v="hotel"/><tag k="name:en" v="Honey Yard"/></node>
<node id="22" lat="48.5" lon="23.5"><tag k="name" v="In the hole"/><tag k="shop" v="x"/></node>
<way id="30"><nd ref="1"/><nd ref="2"/><nd ref="3"/></way><way id="31"><nd ref="3"/><nd ref="4"/><nd ref="1"/></way>
<way id="32"><nd ref="5"/><nd ref="6"/><nd ref="7"/><nd ref="8"/><nd ref="5"/><tag k="name" v="Square"/><tag k="building" v="yes"/></way>
<way id="33"><nd ref="1"/><nd ref="2"/><tag k="name" v="South Road"/><tag k="highway" v="primary"/></way>
<relation id="40"><member type="way" ref="30" role="outer"/><member type="way" ref="31" role="outer"/><member type="way" ref="32" role="inner"/>
<tag k="name" v="District"/><tag k="boundary" v="administrative"/><tag k="type" v="boundary"/><tag k="admin_level" v="8"/></relation></osm>"""
)


@pytest.fixture
def extract(tmp_path):
    (tmp_path / "x.osm").write_text(EXTRACT, encoding="utf-8")
    return str(tmp_path / "x.osm")


def test_objects(spark, extract):
    rows = {(r["osm_type"], r["osm_id"]): r for r in osm.objects(*osm.read_xml(spark, extract)).collect()}
    assert set(rows) == {("n", 20), ("n", 21), ("n", 22), ("w", 32), ("w", 33), ("a", 64), ("a", 81)}
    assert [len(poly) for poly in rows["a", 81]["polys"]] == [2] and len(rows["w", 33]["line"]) == 2
    at = {r["osm_id"]: (round(r["lon"], 6), round(r["lat"], 6)) for r in ingest.located(osm.objects(*osm.read_xml(spark, extract))).collect()}
    assert at[64] == (23.5, 48.5) == at[81] and at[33] == (23.5, 48.0)


def test_from_file_to_hits(spark, extract, tmp_path):
    out = str(tmp_path / "out")
    places, names = cli.build(spark, extract, out)
    assert places == 5 and names > places  # town, hotel, shop, and the square as a way and as an area
    hits = {q: cli.find(spark, out, q, near=(48.3, 23.3)).collect() for q in ("медовий двір славсько", "medovyi dvir slavsko", "Honey Yard District", "In the hole district")}
    assert all(h and h[0]["name"] == "Медовий двір" for q, h in hits.items() if "hole" not in q)
    assert not hits["In the hole district"]
    assert cli.build(spark, extract, out) == (places, names)
    assert hits["Honey Yard District"][0]["metres"] < 200


def test_probes_stage_and_audit(spark, extract, tmp_path):
    out = str(tmp_path / "out")
    places, names = cli.build(spark, extract, out)
    ids = [r["place_id"] for r in spark.read.parquet(f"{out}/places").collect()]
    assert sorted(ids) == list(range(1, places + 1))
    nodes = spark.read.format("xml").option("rowTag", "node").load(f"{out}/nodes.osm")
    assert nodes.count() == names and sorted(r["_id"] for r in nodes.collect()) == list(range(1, names + 1))
    assert cli.probe(spark, out) == 4
    probes = {r["tag"][0]["_v"]: r["_id"] for r in spark.read.format("xml").option("rowTag", "node").load(f"{out}/probes.osm").collect()}
    assert set(probes) == {"place=town", "tourism=hotel", "shop=x", "building=yes"}
    (tmp_path / "seen.txt").write_text("".join(f"poi osmid={k}\n" for c, k in probes.items() if c != "shop=x"))
    total, rescued = cli.stage(spark, out, str(tmp_path / "seen.txt"))
    assert total == names and rescued == 1
    staged = spark.read.format("xml").option("rowTag", "node").load(f"{out}/staged.osm").collect()
    assert [[tuple(t) for t in r["tag"]][1:] for r in staged if r["tag"][0]["_v"].startswith("In the hole")] == [[("shop", "x"), ("place", "locality")]]
    (tmp_path / "all.txt").write_text("".join(f"osmid={r['_id']}\n" for r in staged))
    assert cli.audit(spark, out, str(tmp_path / "all.txt")) == names
    (tmp_path / "most.txt").write_text("osmid=1\n")
    with pytest.raises(ValueError, match="lost"):
        cli.audit(spark, out, str(tmp_path / "most.txt"))
