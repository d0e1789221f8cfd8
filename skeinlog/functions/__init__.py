"""skeinlog.functions"""
