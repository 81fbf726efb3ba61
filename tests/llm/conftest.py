import os

import pytest


@pytest.fixture(scope="session")
def vocabulary():
    from gristmill.llm.tokens import VOCABULARY

    if not os.path.exists(VOCABULARY):
        pytest.skip("no vocabulary")
    return VOCABULARY
