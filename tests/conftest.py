import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ledgerscope.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="ledgerscope-tests")
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SF


# The two single transactions used across the tests.
FRAUD_LIKE = {"step": 5, "type": "TRANSFER", "amount": 1500000.0, "oldbalanceOrg": 1500000.0,
              "newbalanceOrig": 0.0, "oldbalanceDest": 0.0, "newbalanceDest": 0.0}
ORDINARY = {"step": 200, "type": "CASH_OUT", "amount": 5000.0, "oldbalanceOrg": 20000.0, "newbalanceOrig": 15000.0,
            "oldbalanceDest": 3000.0, "newbalanceDest": 8000.0, "hist_dest_txn_count": 12,
            "hist_dest_unique_origin_count": 9, "hist_dest_total_amount": 60000.0, "hist_dest_avg_amount": 5000.0,
            "hist_dest_max_amount": 9000.0}
