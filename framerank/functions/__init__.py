"""Part of framerank."""
