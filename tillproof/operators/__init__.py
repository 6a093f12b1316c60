"""Operators on bills, receipts, frames and rasters; each maps DataFrames to DataFrames."""
