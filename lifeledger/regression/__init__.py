"""Treatment-coded designs and cost regression."""
