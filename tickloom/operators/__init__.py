"""tickloom.operators"""
