"""Ready-made operators over the transaction table."""
