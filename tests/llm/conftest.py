import pytest


@pytest.fixture(autouse=True)
def _checkpoints(spark, tmp_path_factory):
    from civictally.session import shared_dir

    shared_dir(spark)
