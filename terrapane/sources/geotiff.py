"""GeoTIFF rasters of the plain kind: strips or tiles, not compressed or deflated, in degrees."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: Sizes and struct codes of TIFF's field types, by number.
TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, None), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
#: Tags by number, as the TIFF and GeoTIFF standards have them.
WIDTH, HEIGHT, BITS, CODING, PLANES, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, LAYOUT, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, PIXEL_SCALE, TIE_POINTS, GEO_KEYS, NO_DATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
#: GeoTIFF's key for the kind of coordinates, and its value for longitude and latitude.
MODEL_TYPE, GEOGRAPHIC = 1024, 2


class GeoTiff:
    """The first image of a file: its pixels by band, and where they lie."""

    def __init__(self, data: bytes):
        self.data = data
        self.end = {b"II": "<", b"MM": ">"}.get(data[:2])
        if self.end is None or len(data) < 8 or struct.unpack_from(self.end + "H", data, 2)[0] != 42:
            raise ValueError("not a TIFF file of the classic kind")
        self.tags = dict(self._tags(struct.unpack_from(self.end + "I", data, 4)[0]))
        self.width, self.height = self.tags[WIDTH][0], self.tags[HEIGHT][0]
        self.bands = self.tags.get(SAMPLES, (1,))[0]
        kind = {1: "u", 2: "i", 3: "f"}[self.tags.get(FORMAT, (1,))[0]]
        self.dtype = np.dtype(f"{self.end}{kind}{self.tags.get(BITS, (8,))[0] // 8}")
        if PIXEL_SCALE not in self.tags or TIE_POINTS not in self.tags:
            raise ValueError("the TIFF file doesn't say where its pixels lie")
        keys = self.tags.get(GEO_KEYS, ())
        model = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}.get(MODEL_TYPE, GEOGRAPHIC)
        self.crs = "WGS84" if model == GEOGRAPHIC else "projected"

    def _tags(self, at: int) -> Iterator[tuple[int, tuple]]:
        for i in range(struct.unpack_from(self.end + "H", self.data, at)[0]):
            tag, kind, n = struct.unpack_from(self.end + "HHI", self.data, at + 2 + 12 * i)
            size, code = TYPES.get(kind, (0, None))
            if code is None:
                continue
            place = at + 10 + 12 * i if size * n <= 4 else struct.unpack_from(self.end + "I", self.data, at + 10 + 12 * i)[0]
            yield tag, (self.data[place : place + n].rstrip(b"\0").decode("latin-1"),) if code == "c" else struct.unpack_from(f"{self.end}{n}{code}", self.data, place)

    @property
    def coordinates(self) -> tuple[np.ndarray, np.ndarray]:
        """Longitudes of columns and latitudes of rows, at the pixels' centres."""
        dx, dy = self.tags[PIXEL_SCALE][:2]
        i, j, _, x, y = self.tags[TIE_POINTS][:5]
        return x + (np.arange(self.width) - i + 0.5) * dx, y - (np.arange(self.height) - j + 0.5) * dy

    @property
    def spacing(self) -> tuple[float, float]:
        return tuple(float(x) for x in self.tags[PIXEL_SCALE][:2])

    def _parts(self) -> Iterator[tuple[int, int, int, int, int, int, int]]:
        """(plane, row, column, rows, columns, place, bytes) of each strip or tile."""
        if TILES in self.tags:
            w, h, places, sizes = self.tags[TILE_WIDTH][0], self.tags[TILE_HEIGHT][0], self.tags[TILES], self.tags[TILE_BYTES]
        else:
            w, h, places, sizes = self.width, min(self.height, self.tags.get(STRIP_ROWS, (self.height,))[0]), self.tags[STRIPS], self.tags[STRIP_BYTES]
        across, down = -(-self.width // w), -(-self.height // h)
        for k, (place, size) in enumerate(zip(places, sizes, strict=True)):
            plane, r = divmod(k, across * down)
            rows = h if TILES in self.tags else min(h, self.height - r // across * h)
            yield plane, r // across * h, r % across * w, rows, w, place, size

    def band(self, band: int = 1) -> np.ndarray:
        """A band's values as doubles, NaN where the file has none."""
        coding, predictor = self.tags.get(CODING, (1,))[0], self.tags.get(PREDICTOR, (1,))[0]
        if coding not in (1, 8, 32946) or predictor not in (1, 2):
            raise NotImplementedError(f"TIFF coding {coding} with predictor {predictor} can't be read")
        apart = self.tags.get(LAYOUT, (1,))[0] == 2 and self.bands > 1
        samples = 1 if apart else self.bands
        out = np.zeros((self.height, self.width))
        for plane, row, column, rows, columns, place, size in self._parts():
            if apart and plane != band - 1:
                continue
            data = self.data[place : place + size]
            data = data if coding == 1 else zlib.decompress(data)
            part = np.frombuffer(data, self.dtype, rows * columns * samples).reshape(rows, columns, samples)
            if predictor == 2:
                part = np.cumsum(part, axis=1, dtype=self.dtype)
            part = part[: self.height - row, : self.width - column, 0 if apart else band - 1]
            out[row : row + part.shape[0], column : column + part.shape[1]] = part
        gone = self.tags.get(NO_DATA, ("",))[0].strip()
        if gone:
            out[out == float(gone)] = np.nan
        return out
