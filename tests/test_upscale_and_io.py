"""Coarse networks on a 160 x 200 raster of D8 codes, subbasins, files."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.functions.grid import GridSpec
from thalweg.operators import FlowNetwork, basins, upscale
from thalweg.plans import saved
from thalweg.sources import load, read_ascii, read_nextxy, save

DATA = Path(__file__).parent / "data" / "flow_160x200.txt"


@pytest.fixture(scope="module")
def net(spark):
    cells, nrow, ncol = read_ascii(spark, str(DATA))
    assert (nrow, ncol) == (160, 200)
    return FlowNetwork.from_array(cells.select("row", "col", F.col("value").cast("int").alias("code")), GridSpec(nrow, ncol))


@pytest.fixture(scope="module")
def uparea(net):
    return saved(net.upstream_area())


@pytest.mark.parametrize("method, errors", [("dmm", 33), ("eam", 4), ("eam_plus", 2)])
def test_disconnected_cells(net, uparea, method, errors):
    coarse, out = upscale.upscale(net, 20, method, uparea)
    assert coarse.is_valid()
    assert upscale.upscale_error(net, coarse, out).where("connected = 0").count() == errors


@pytest.mark.parametrize("factor, errors", [(40, 0), (20, 1), (10, 4), (5, 7)])
def test_moved_outlets(net, uparea, factor, errors):
    """No more cells are disconnected than are known of the iterative method."""
    coarse, out = upscale.upscale(net, factor, uparea=uparea)
    assert coarse.is_valid()
    assert out.join(net.cells, F.col("pixel") == F.col("idx")).where(upscale.coarse_cell(net.grid, factor, "idx") != F.col("cell")).isEmpty()
    assert upscale.upscale_error(net, coarse, out).where("connected = 0").count() <= errors


def test_pfafstetter_levels_nest(net, uparea):
    one = basins.subbasins_pfafstetter(net, 1, uparea, 50).withColumnRenamed("basin", "a")
    two = basins.subbasins_pfafstetter(net, 2, uparea, 50).withColumnRenamed("basin", "b")
    both = one.join(two, "idx")
    assert both.count() > 0 and both.where(F.floor(F.col("b") / 10) != F.col("a")).isEmpty()
    assert both.where(~F.col("a").between(1, 9)).isEmpty()


def test_subbasins_have_the_area(net, uparea):
    labels = saved(basins.subbasins_area(net, 200, uparea))
    assert labels.count() == net.n_nodes()
    outlets = basins.basin_outlets(net, labels)
    assert outlets.groupBy("region").count().where("count > 1").isEmpty()
    sizes = labels.groupBy("basin").count().join(outlets.withColumnRenamed("region", "basin"), "basin").join(net.cells, "idx")
    assert sizes.where("idx <> idx_ds and count <= 200").isEmpty()


def test_files(spark, net, tmp_path):
    save(net, str(tmp_path / "net"))
    again = load(spark, str(tmp_path / "net"))
    assert again.grid == net.grid and again.cells.exceptAll(net.cells).isEmpty()
    x = np.array([[2, -9999], [2, -9]], "<i4")
    y = np.array([[1, -9999], [2, -9]], "<i4")
    (tmp_path / "xy.bin").write_bytes(np.stack((x, y)).tobytes())
    cells, grid = read_nextxy(spark, str(tmp_path / "xy.bin"), 2, 2, (0.0, 0.0, 2.0, 2.0))
    small = FlowNetwork.from_array(cells, grid, "infer")
    # the first cell aims at a missing one and so is a pit
    assert sorted(map(tuple, small.cells.collect())) == [(0, 0), (2, 3), (3, 3)]
    with pytest.raises(ValueError):
        FlowNetwork.from_array(net.to_array("d8").withColumn("code", F.lit(77)), net.grid)


def test_solved_paths_are_written_once(net, uparea, monkeypatch):
    """What ``ascend`` returns is a saved table already and isn't saved a second time."""
    tags, keep = [], upscale.saved

    def counted(df, tag):
        tags.append(tag)
        return keep(df, tag)

    monkeypatch.setattr(upscale, "saved", counted)
    upscale.upscale_error(net, *upscale.upscale(net, 20, "eam_plus", uparea)).count()
    assert tags == ["uparea", "outlets", "coarse"]
