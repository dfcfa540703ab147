"""Command line of the watershed finder: python -m lacuna.cli [CONFIG | -c CONFIG] TABLE OUT [-m METHOD] [-v] [-w FOLDER]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lacuna.plans.watershed import Watershed, WatershedConfig
from lacuna.sources.tables import Catalog, read_table, with_row_numbers


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("paths", nargs="+", help="the settings (an ini file) unless -c names them, the table, the folder to write")
    p.add_argument("-m", "--method", default="0", help="0-5, VIDE, ZOBOV, ZOBOV2, ZOBOV3, REVOLVER or REVOLVER2")
    p.add_argument("-c", "--config", help="settings, an ini file")
    p.add_argument("-v", "--visualize", action="store_true", help="also save triangles of the voids' surfaces, and the galaxies' voids")
    p.add_argument("-w", "--save-intermediate", metavar="FOLDER", help="keep the stages' tables there, and go on from what it holds")
    p.add_argument("-p", "--periodic", action="store_true")
    p.add_argument("-x", "--xyz", action="store_true")
    a = p.parse_args(argv)
    paths = [a.config, *a.paths] if a.config else a.paths
    if len(paths) != 3:
        p.error("settings, a table and a folder to write are needed")
    a.config, a.table, a.out = paths
    spark = SparkSession.builder.getOrCreate()
    config = WatershedConfig.from_ini(a.config)
    config.periodic, config.xyz = a.periodic, a.xyz or a.periodic
    galaxies = read_table(spark, a.table)
    if "redshift" not in galaxies.columns and "z" in galaxies.columns and not config.xyz:
        galaxies = galaxies.withColumnRenamed("z", "redshift")
    order = ["x", "y", "z"] if config.xyz else ["ra", "dec", "redshift"]
    run = Watershed(galaxies if "gal" in galaxies.columns else with_row_numbers(galaxies, "gal", order), config, a.save_intermediate)
    method = int(a.method) if a.method.isdigit() else a.method
    tables = run.sort_voids(method)
    if a.visualize:
        tables |= run.pictures(tables["zonevoid"])
    Catalog(tables, {"METHOD": str(method)}).update(spark, a.out)


if __name__ == "__main__":
    main()
