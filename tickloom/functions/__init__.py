"""tickloom.functions"""
