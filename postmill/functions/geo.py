"""Geohash arithmetic on cell numbers, written as built-in expressions.

A geohash of ``n`` characters numbers a grid of ``2**ceil(5n/2)`` columns by
``2**floor(5n/2)`` rows and interleaves the two numbers, column bit first. Working
on the cell numbers keeps encoding, decoding and box cover inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the geohash alphabet, in value order (also ASCII order).
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
STORED_PRECISION = 10
MAX_PRECISION = 12


def grid_bits(precision: int) -> tuple[int, int]:
    """(column bits, row bits) of the grid at a precision."""
    if not 1 <= precision <= MAX_PRECISION:
        raise ValueError(f"precision must be 1..{MAX_PRECISION}")
    total = 5 * precision
    return total - total // 2, total // 2


def wrap_longitude(lon: Column) -> Column:
    """Bring any longitude into [-180, 180]; values already inside stay as they are."""
    turns = F.floor((F.abs(lon) + 180.0) / 360.0)
    return F.when(F.abs(lon) <= 180.0, lon).otherwise(F.signum(lon) * (F.abs(lon) - turns * 360.0))


def lon_cell(lon: Column, precision: int) -> Column:
    """Grid column of a longitude; the +180 edge belongs to the last column."""
    n = 1 << grid_bits(precision)[0]
    return _at_most(F.floor((wrap_longitude(lon) + 180.0) / 360.0 * float(n)), n - 1)


def lat_cell(lat: Column, precision: int) -> Column:
    """Grid row of a latitude; null outside [-90, 90]."""
    n = 1 << grid_bits(precision)[1]
    cell = _at_most(F.floor((lat + 90.0) / 180.0 * float(n)), n - 1)
    return F.when(lat.between(-90.0, 90.0), cell)


def _at_most(cell: Column, top: int) -> Column:
    # Not ``least``, which would turn a null into the limit.
    return F.when(cell > top, F.lit(top).cast("bigint")).otherwise(cell)


def _two_letters(lon5: int, lat5: int) -> str:
    """The two letters that five column bits and five row bits interleave to."""
    z = 0
    for bit in range(4, -1, -1):
        z = (z << 2) | ((lon5 >> bit & 1) << 1) | (lat5 >> bit & 1)
    return ALPHABET[z >> 5] + ALPHABET[z & 31]


def _one_letter(lon3: int, lat2: int) -> str:
    """The last letter of an odd length: three column bits around two row bits."""
    bits = (lon3 >> 2, lat2 >> 1, lon3 >> 1, lat2, lon3)
    return ALPHABET[int("".join(str(b & 1) for b in bits), 2)]


def _lookup(entries: list) -> Column:
    """An array constant; built from one text so that the plan stays small."""
    if isinstance(entries[0], int):
        return F.split(F.lit(",".join(map(str, entries))), ",").cast("array<bigint>")
    return F.split(F.lit(",".join(entries)), ",")


# Tables indexed by 32 * column bits + row bits, and by 32 * first letter + second letter.
PAIRS = [_two_letters(x, y) for x in range(32) for y in range(32)]
SINGLES = [_one_letter(x, y) for x in range(8) for y in range(4)]
PAIR_AT = {pair: divmod(i, 32) for i, pair in enumerate(PAIRS)}
SINGLE_AT = {letter: divmod(i, 4) for i, letter in enumerate(SINGLES)}


def _bits(idx: Column, shift: int, width: int) -> Column:
    moved = F.shiftright(idx, shift) if shift else idx
    return moved.bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def cells_to_hash(lon_idx: Column, lat_idx: Column, precision: int) -> Column:
    """Geohash text of a grid cell: one table look-up per two letters."""
    lon_left, lat_left = grid_bits(precision)
    letters = []
    while lat_left >= 5:
        lon_left, lat_left = lon_left - 5, lat_left - 5
        at = _bits(lon_idx, lon_left, 5) * 32 + _bits(lat_idx, lat_left, 5)
        letters.append(F.get(_lookup(PAIRS), at))
    if lon_left:
        letters.append(F.get(_lookup(SINGLES), _bits(lon_idx, 0, 3) * 4 + _bits(lat_idx, 0, 2)))
    return F.concat(*letters)


def geohash_encode(lat: Column, lon: Column, precision: int = STORED_PRECISION) -> Column:
    """Geohash of a point; null for a null or out-of-range latitude or a null longitude."""
    return cells_to_hash(lon_cell(lon, precision), lat_cell(lat, precision), precision)


def hash_to_cells(geo_hash: Column, precision: int) -> tuple[Column, Column]:
    """(grid column, grid row) of the first ``precision`` characters of a geohash."""

    def letter(k: int) -> Column:
        place = F.instr(F.lit(ALPHABET), F.substring(geo_hash, k + 1, 1)).cast("bigint") - 1
        return F.when(place >= 0, place)

    by_letters = [PAIR_AT[a + b] for a in ALPHABET for b in ALPHABET]
    by_letter = [SINGLE_AT[a] for a in ALPHABET]
    columns, rows = [F.lit(0).cast("bigint")], [F.lit(0).cast("bigint")]
    for k in range(0, precision - 1, 2):
        at = letter(k) * 32 + letter(k + 1)
        for axis, out in ((0, columns), (1, rows)):
            out.append(out[-1] * 32 + F.get(_lookup([c[axis] for c in by_letters]), at))
    if precision % 2:
        at = letter(precision - 1)
        columns.append(columns[-1] * 8 + F.get(_lookup([c[0] for c in by_letter]), at))
        rows.append(rows[-1] * 4 + F.get(_lookup([c[1] for c in by_letter]), at))
    return columns[-1], rows[-1]


def geohash_decode(geo_hash: Column, precision: int = STORED_PRECISION) -> Column:
    """``struct(lon, lat)`` of the centre of a cell."""
    lon_bits, lat_bits = grid_bits(precision)
    lon_idx, lat_idx = hash_to_cells(geo_hash, precision)
    lon = (lon_idx + 0.5) / float(1 << lon_bits) * 360.0 - 180.0
    lat = (lat_idx + 0.5) / float(1 << lat_bits) * 180.0 - 90.0
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def bbox_center(box: Column) -> Column:
    """``struct(lon, lat)`` half way between corners 0 and 2 of a box's outer ring."""
    ring = F.get(box, F.lit(0))
    low, high = F.get(ring, F.lit(0)), F.get(ring, F.lit(2))

    def middle(axis: int) -> Column:
        return (F.get(low, F.lit(axis)) + F.get(high, F.lit(axis))) / 2

    return F.struct(middle(0).alias("lon"), middle(1).alias("lat"))


def resolve_point(point: Column, box: Column) -> Column:
    """``struct(lon, lat)``: the exact ``[lon, lat]`` point if given, else the box centre."""
    exact = F.struct(F.get(point, F.lit(0)).alias("lon"), F.get(point, F.lit(1)).alias("lat"))
    return F.when(point.isNotNull(), exact).otherwise(bbox_center(box))


def geohash_cover(
    boxes: DataFrame,
    precision: int,
    nw_lat: str = "nw_lat",
    nw_lon: str = "nw_lon",
    se_lat: str = "se_lat",
    se_lon: str = "se_lon",
    name: str = "prefix",
) -> DataFrame:
    """One row per (box, grid cell the box touches), the cell as ``name``.

    A box whose west edge lies east of its east edge crosses the antimeridian.
    Columns and rows are generated row by row, so nothing is held per box but the
    two short axis sequences.
    """
    columns = 1 << grid_bits(precision)[0]
    west = lon_cell(F.col(nw_lon), precision)
    east = lon_cell(F.col(se_lon), precision)
    crosses = wrap_longitude(F.col(nw_lon)) > wrap_longitude(F.col(se_lon))
    last = F.when(crosses, F.least(east + columns, west + columns - 1)).otherwise(east)
    south = lat_cell(_clip(F.col(se_lat)), precision)
    north = lat_cell(_clip(F.col(nw_lat)), precision)
    keep = [F.col(c) for c in boxes.columns]
    return (
        boxes.where(north >= south)
        .select(*keep, F.explode(F.sequence(west, last)).alias("_lon"))
        .select(*keep, "_lon", F.explode(F.sequence(south, north)).alias("_lat"))
        .select(*keep, cells_to_hash(F.col("_lon") % columns, F.col("_lat"), precision).alias(name))
    )


def _clip(lat: Column) -> Column:
    return F.when(lat > 90.0, 90.0).when(lat < -90.0, -90.0).otherwise(lat)


def in_box_cells(geo_hash: Column, box: tuple[float, float, float, float], precision: int) -> Column:
    """Whether a stored geohash falls in a cell that touches the box.

    Same answer as matching the prefix against the box's full cover, but row-local:
    two range tests on the cell numbers, whatever the number of cells. The plain text
    bounds in front come from the interleaved order (south-west cell lowest, north-east
    highest) and fold to literals that reach the file scan as pushed filters.
    """
    nw_lat, nw_lon, se_lat, se_lon = (F.lit(float(v)) for v in box)
    nw_lat, se_lat = _clip(nw_lat), _clip(se_lat)
    lon_idx, lat_idx = hash_to_cells(geo_hash, precision)
    west, east = lon_cell(nw_lon, precision), lon_cell(se_lon, precision)
    rows = lat_idx.between(lat_cell(se_lat, precision), lat_cell(nw_lat, precision))
    if wrapped(box[1]) > wrapped(box[3]):
        return ((lon_idx >= west) | (lon_idx <= east)) & rows
    low = geohash_encode(se_lat, nw_lon, precision)
    high = F.concat(geohash_encode(nw_lat, se_lon, precision), F.lit("~"))
    return (geo_hash >= low) & (geo_hash < high) & lon_idx.between(west, east) & rows


def wrapped(lon: float) -> float:
    """``wrap_longitude`` for a plain number."""
    if abs(lon) <= 180.0:
        return lon
    size = abs(lon)
    size -= ((size + 180.0) // 360.0) * 360.0
    return size if lon > 0 else -size
