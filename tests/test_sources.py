"""Readers, catalogue folders, resumable batches, and the stream of flags."""

import struct

import pytest
from pyspark.sql import functions as F

from lacuna.sources import tables
from lacuna.streaming.flags import flag_stream


def card(name, value):
    return f"{name:<8}= {value:>20}".ljust(80)


def fits_file(path, rows):
    def block(cards):
        text = "".join(c.ljust(80) for c in [*cards, "END"])
        return text.ljust(-(-len(text) // 2880) * 2880).encode()

    data = b"".join(struct.pack(">dfi", *r[:3]) + r[3].encode().ljust(4) for r in rows)
    head = [card("XTENSION", "'BINTABLE'"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", 20), card("NAXIS2", len(rows)), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", 4)]
    for k, (n, f) in enumerate((("ra", "D"), ("dec", "E"), ("id", "J"), ("tag", "4A")), 1):
        head += [card(f"TTYPE{k}", f"'{n}'"), card(f"TFORM{k}", f"'{f}'")]
    path.write_bytes(block([card("SIMPLE", "T"), card("BITPIX", 8), card("NAXIS", 0)]) + block(head) + data.ljust(-(-len(data) // 2880) * 2880, b"\0"))


def test_fits(spark, tmp_path):
    fits_file(tmp_path / "t.fits", [(10.5, -2.5, 7, "ab"), (20.25, 3.5, -1, "cdef")])
    rows = tables.read_table(spark, str(tmp_path / "t.fits")).orderBy("ra").collect()
    assert [tuple(r) for r in rows] == [(10.5, -2.5, 7, "ab"), (20.25, 3.5, -1, "cdef")]


def test_text(spark, tmp_path):
    (tmp_path / "t.dat").write_text("# ra dec  redshift\n1.5 -2  0.1\n\n  3 4 0.2\n")
    rows = tables.read_table(spark, str(tmp_path / "t.dat")).orderBy("ra").collect()
    assert [tuple(r) for r in rows] == [(1.5, -2.0, 0.1), (3.0, 4.0, 0.2)]
    with pytest.raises(ValueError, match="HDF5"):
        tables.read_table(spark, "x.h5")


def test_catalogue(spark, tmp_path):
    voids = spark.range(5).select(F.col("id").alias("VOID"), (F.col("id") * 2.0).alias("Radius"))
    tables.Catalog({"maximals": voids}, {"VOLUME": 12.3456}).save(str(tmp_path / "c"))
    back = tables.Catalog.read(spark, str(tmp_path / "c"))
    assert back.info == {"VOLUME": 12.35} and back["MAXIMALS"].columns == ["void", "radius"] and back["maximals"].count() == 5
    back.add_galaxies(spark.createDataFrame([(20.0, 1.0, 0.02), (10.0, 0.0, 0.01)], "ra double, dec double, redshift double"), ["ra"])
    assert [(r["gal"], r["ra"]) for r in back["galaxies"].orderBy("gal").collect()] == [(0, 10.0), (1, 20.0)]
    assert {"x", "y", "z", "Rgal"} <= set(back["galaxies"].columns)


def test_batches_resume(spark, tmp_path):
    work = spark.range(20).withColumn("b", F.col("id") % 4)
    seen = []

    def run(df):
        seen.append(df.count())
        if len(seen) == 3:
            raise RuntimeError("lost")
        return df.select("id")

    with pytest.raises(RuntimeError):
        tables.in_batches(work, "id", "b", str(tmp_path / "w"), run)
    assert tables.in_batches(work, "id", "b", str(tmp_path / "w"), run).count() == 20
    assert len(seen) == 5


def test_stream(spark, tmp_path):
    holes = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 2.0), (1, 10.0, 0.0, 0.0, 1.0)], "hole long, x double, y double, z double, radius double")
    spark.createDataFrame([(1, 0.5, 0.0, 0.0), (2, 5.0, 0.0, 0.0), (3, 10.5, 0.0, 0.0)], "gal long, x double, y double, z double").write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema("gal long, x double, y double, z double").parquet(str(tmp_path / "in"))
    q = flag_stream(arriving, holes, 2.0).writeStream.format("memory").queryName("flagged").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("flagged").collect()) == [(1, 0), (3, 1)]
