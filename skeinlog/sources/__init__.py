"""skeinlog.sources"""
