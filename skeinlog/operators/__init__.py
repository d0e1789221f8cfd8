"""skeinlog.operators"""
