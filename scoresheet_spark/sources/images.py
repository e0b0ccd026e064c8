"""Decoding of images, turned upright. Arrays are (height, width, 3), blue-green-red."""

from __future__ import annotations

import numpy as np

#: The EXIF tag of the orientation; a fixed value.
ORIENTATION = 0x0112


def exif_orientation(content: bytes) -> int:
    """The orientation, 1 to 8, that a JPEG file's EXIF segment tells; 1 where there is none."""
    at = 2
    while content[:2] == b"\xff\xd8" and at + 4 <= len(content) and content[at] == 0xFF:
        marker, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        body = content[at + 4 : at + 2 + size]
        if marker == 0xE1 and body[:6] == b"Exif\0\0":
            tiff = body[6:]
            order = "little" if tiff[:2] == b"II" else "big"
            number = lambda i, n: int.from_bytes(tiff[i : i + n], order)  # noqa: B023, E731
            first = number(4, 4)
            for k in range(number(first, 2)):
                entry = first + 2 + 12 * k
                if number(entry, 2) == ORIENTATION:
                    said = number(entry + 8, 2)
                    return said if 1 <= said <= 8 else 1
            return 1
        if marker == 0xDA:  # the picture begins
            break
        at += 2 + size
    return 1


def upright(image: np.ndarray, orientation: int) -> np.ndarray:
    """The image as it is meant to be seen: mirrored and turned back by its orientation."""
    if orientation in (2, 4, 5, 7):
        image = image[:, ::-1]
    turns = {3: 2, 4: 2, 5: 1, 6: 3, 7: 3, 8: 1}.get(orientation, 0)  # counter-clockwise
    return np.ascontiguousarray(np.rot90(image, turns))


def decode(content: bytes) -> np.ndarray | None:
    """An image file as an upright array, None where it is none. Needs Pillow, which the library does not require."""
    import io

    from PIL import Image

    try:
        pixels = np.asarray(Image.open(io.BytesIO(content)).convert("RGB"))
    except (OSError, ValueError):
        return None
    return upright(pixels[:, :, ::-1], exif_orientation(content))
