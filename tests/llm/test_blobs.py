import numpy as np

from tickerloom.llm import blobs


def test_arrays_come_back_mapped(tmp_path):
    folder = f"file://{tmp_path}/deep/er"
    values = np.arange(1000, dtype=np.uint64) * np.uint64(1 << 54)
    blobs.write_array(folder, "a-1", values)
    blobs.write_array(folder, "a-1", values)  # a repeated task leaves one whole file
    found = blobs.map_array(folder, "a-1")
    assert isinstance(found, np.memmap) and np.array_equal(found, values)
    blobs.write_array(str(tmp_path), "none", values[:0])
    assert len(blobs.map_array(str(tmp_path), "none")) == 0
    assert sorted(p.name for p in (tmp_path / "deep" / "er").iterdir()) == ["a-1.npy"]
